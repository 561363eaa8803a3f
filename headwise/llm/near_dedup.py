"""Near-duplicate documents: a set similarity join over chosen paths of minwise tokens.

A document is the set of its word shingles. Equal sets are one *class*, named by its smallest doc_id, before anything is
compared. A tree puts every class into the node of one minwise token of its set; a node that is still large branches by
a further token, chosen by the node's name, into smaller ones. Two sets of similarity s share each chosen token with
probability s. Small nodes are compared exhaustively: pairs whose minwise tokens could belong to linked sets are
confirmed on full sets, and only for these are texts fetched. Independent trees are repeated until a link is missed with
a small probability (see `MISS`).

Only connections matter for components, so a node is looked at only while it spans several components, and a comparison
is made only between different ones. Groups of near copies never become small nodes: after `DEPTH` branchings a large
node is dealt into blocks, each with the same few pivots, which joins nearly all of it in linear work. What a large
node still holds of several components in the end is compared exhaustively, outsiders of its largest component against
all members, in pairs of blocks, in every tree: two given members of a large node hardly ever meet in a dealt block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm import hashing, storage

SHINGLE = 5
#: Minwise tokens of a set, four bytes each.
TOKENS = 64
#: Probability to miss a pair that is just similar enough and whose nodes all branch DEPTH times. A tree brings it together
#: with the similarity to the power of 1 + DEPTH, at 0.85 with 0.61 and at 0.80 with 0.51, which takes 8 and 11 trees.
MISS = 5e-4
DEPTH = 2
#: Trees of the first round, which joins most of what is alike; the second round has the others.
FIRST = 2
#: Classes that are compared at once, and pivots that each block of a large node gets besides.
LEAF, PIVOTS = 64, 3
#: Probability that fewer minwise tokens of a pair that is just similar enough agree than exact comparison asks for.
UNLIKE = 5e-5
#: Rows given to one call, and bytes of shingle sets that it remembers.
TASK_ROWS, KNOWN = 512, 32 << 20
#: Bits of the filter for each class whose text is fetched, and bits at most (32 MB); beyond, more other texts pass it.
BITS, MOST_BITS = 16, 1 << 28


def _trees(percent: int) -> int:
    """Trees that miss a pair with a probability of at most MISS."""
    together = min(max(percent, 1) / 100, 1 - 1e-9) ** (1 + DEPTH)
    return max(FIRST + 1, math.ceil(math.log(MISS) / math.log1p(-together)))


def _agree(percent: int) -> int:
    """Minwise tokens that must agree for exact comparison: at 0.85 42, at 0.80 38."""
    s, below = min(max(percent, 0), 100) / 100, 0.0
    for n in range(TOKENS):
        below += math.comb(TOKENS, n) * s**n * (1 - s) ** (TOKENS - n)
        if below > UNLIKE:
            return n
    return TOKENS


_rng = np.random.default_rng(20240601)
_FACTORS = _rng.integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, TOKENS, np.uint64)


def _lower(text: bytes | None) -> bytes:
    return (text or b"").translate(_LOWER)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for begin, end in hashing.buffers(texts):
        words, offsets = hashing.words([_lower(x) for x in texts[begin:end]])
        every = hashing.windows(words, np.arange(max(len(words) - SHINGLE + 1, 0)), SHINGLE)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(every[a : b - SHINGLE + 1])
            else:
                yield hashing.windows(words[a:b], np.zeros(min(b - a, 1), np.int64), b - a)


def _tokens(members: np.ndarray) -> bytes:
    """Minwise tokens: of each hash function, the upper half of its smallest value over the set."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 4096):
        part = members[i : i + 4096, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        rows = []
        for members in shingle_sets(list(docs["text"])):
            ways = [int(hashing.mix(members ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (1, 2)]
            rows.append((len(members), *ways, _tokens(members) if len(members) else b""))
        out = pd.DataFrame(rows, columns=["size", "sum1", "sum2", "tokens"])
        out.insert(0, "doc_id", docs["doc_id"].to_numpy())
        yield out


def _token(i: Column) -> Column:
    return F.col("tokens").substr(i * 4 + 1, F.lit(4))


def _child(node: Column) -> Column:
    """The node below: the token that `node` chooses."""
    at = F.pmod(F.xxhash64(node, F.lit("child")), F.lit(TOKENS)).cast("int")
    return F.xxhash64(node, _token(at))


def _spanning(nodes: DataFrame) -> DataFrame:
    """Nodes with classes of several components: node, members."""
    counted = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    return counted.where("lo < hi").select("node", "members")


def _nodes(classes: DataFrame, trees: range) -> tuple[DataFrame, DataFrame]:
    """Members of the small nodes and of the large ones after all branchings: node, class, component."""
    columns = ["node", "class", "component"]
    level = classes.select(
        F.explode(F.array(*[F.xxhash64(F.lit(t), _token(F.lit(t * 7 % TOKENS))) for t in trees])).alias("node"),
        "class", "component",
    )
    small: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        level = storage.staged(level.join(_spanning(level), "node"), "nodes")
        small.append(level.where(F.col("members") <= LEAF).select(columns))
        large = level.where(F.col("members") > LEAF).select("members", *columns)
        if depth == DEPTH or large.isEmpty():
            break
        child = _child(F.col("node")).alias("node")
        level = large.join(classes.select("class", "tokens"), "class").select(child, "class", "component")
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.unionByName(more)
    return leaves, large


def _blocks(large: DataFrame) -> DataFrame:
    """Large nodes dealt into blocks that share pivots: node, class, component."""
    pivots = large.groupBy("node").agg(
        F.max("members").alias("members"),
        F.array(*[F.min_by(F.struct("class", "component"), F.xxhash64("class", F.lit(i))) for i in range(PIVOTS)]).alias("pivots"),
    )
    count = F.ceil(F.col("members") / LEAF)
    dealt = large.select(F.xxhash64("node", F.pmod(F.xxhash64("class"), count)).alias("node"), "class", "component")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block")
    copies = pivots.select("node", "pivots", numbers).select(
        F.xxhash64("node", "block").alias("node"), F.explode(F.array_distinct("pivots")).alias("p")
    )
    return dealt.unionByName(copies.select("node", "p.class", "p.component")).distinct()


def _block_pairs(large: DataFrame) -> DataFrame:
    """Every pair of an outsider and any other member of a large node meets in a node of this: node, class, component.

    Outsiders, the members outside the node's largest component, fill the first blocks, and a pair of blocks is formed
    only if one of them holds outsiders.
    """
    sizes = large.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("node").agg(
        F.max_by("component", "n").alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")
    )
    outside = F.ceil((F.col("n") - F.col("n_main")) / LEAF)
    placed = large.join(main, "node").withColumns({"first": outside, "last": outside + F.ceil(F.col("n_main") / LEAF)})
    slot = F.xxhash64("class")
    block = F.when(F.col("component") == F.col("main"), F.col("first") + F.pmod(slot, F.col("last") - F.col("first")))
    placed = placed.withColumn("block", block.otherwise(F.pmod(slot, F.col("first"))))
    zero, b = F.lit(0).cast("long"), F.col("block")
    before = F.transform(F.sequence(zero, F.least(b, F.col("first") - 1)), lambda a: F.struct(a.alias("a"), b.alias("b")))
    after = F.when(
        b < F.col("first"), F.transform(F.sequence(b, F.col("last") - 1), lambda c: F.struct(b.alias("a"), c.alias("b")))
    )
    pairs = F.explode(F.array_distinct(F.when(after.isNull(), before).otherwise(F.concat(before, after)))).alias("pair")
    return placed.select("node", "class", "component", pairs).select(
        F.xxhash64("node", "pair.a", "pair.b").alias("node"), "class", "component"
    )


def _alike(node: pd.DataFrame, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the later ones of other components whose minwise tokens agree in `least` places."""
    table = np.stack([np.frombuffer(x, "<u4") for x in node["tokens"]])
    component = node["component"].to_numpy()
    for i in range(len(table) - 1):
        agree = (table[i + 1 :] == table[i]).sum(axis=1) >= least
        yield i, np.flatnonzero(agree & (component[i + 1 :] != component[i])) + i + 1


def _candidates(percent: int):
    least = _agree(percent)

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        """Members of nodes that have anyone to be compared with."""
        kept = []
        for _, node in rows.groupby("node", sort=False):
            seen = np.zeros(len(node), bool)
            for i, near in _alike(node, least):
                seen[near] = True
                seen[i] |= len(near) > 0
            kept.append(node[seen])
        return pd.concat(kept)[["node", "class", "component", "tokens"]]

    return candidates


def _compare(percent: int):
    least = _agree(percent)

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between components, enough to connect all that are linked inside each node."""
        links: list[tuple[int, int]] = []
        known: dict[int, np.ndarray] = {}
        held = 0
        text = dict(zip(rows["class"], rows["text"], strict=True))

        def members(c: int) -> np.ndarray:
            nonlocal held
            if c not in known:
                if held > KNOWN:
                    known.clear()
                    held = 0
                known[c] = next(shingle_sets([text[c]]))
                held += known[c].nbytes
            return known[c]

        for _, node in rows.groupby("node", sort=False):
            names, component = node["class"].tolist(), node["component"].tolist()
            root = {c: c for c in component}

            def top(c: int, root: dict = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i, near in _alike(node, least):
                for j in near.tolist():
                    a, b = top(component[i]), top(component[j])
                    if a == b:
                        continue
                    x, y = members(names[i]), members(names[j])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        links.append((component[i], component[j]))
                        root[max(a, b)] = min(a, b)
        return pd.DataFrame(links, columns=["left", "right"], dtype=np.int64)

    return compared


def _dealt(nodes: DataFrame) -> DataFrame:
    """Whole nodes dealt over tasks of about TASK_ROWS members."""
    tasks = max(1, nodes.count() // TASK_ROWS)
    return nodes.withColumn("task", F.pmod(F.xxhash64("node"), F.lit(tasks)))


def _among(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows whose class is among the names, and few others: a broadcast bitmap of hashed names keeps most rows that
    a join with the names would drop from being shuffled for it. Names has one column, class, without repeats."""
    page = 1 << 15  # bits of one bitmap of Spark
    pages = math.ceil(min(max(names.count() * BITS, 1), MOST_BITS) / page)
    place = F.pmod(F.xxhash64("class"), F.lit(pages * page)) + 1
    marked, bit = F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place)
    maps = names.groupBy(marked).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.col("bits").substr((bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("page", marked).join(F.broadcast(maps), "page")
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(rows.columns)


def _links(nodes: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links found inside the nodes: left, right (components)."""
    rows = _dealt(nodes).join(classes.select("class", "tokens"), "class")
    candidates = storage.staged(
        rows.groupBy("task").applyInPandas(_candidates(percent), "node long, class long, component long, tokens binary"), "candidates"
    )
    names = candidates.select("class").distinct()
    content = _among(texts, names).join(names, "class").dropDuplicates(["class"])
    pairs = _dealt(candidates).join(content, "class")
    return pairs.groupBy("task").applyInPandas(_compare(percent), "left long, right long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """Smallest name reachable from each end of a link: old, component. Labels spread to neighbours, then jump ahead."""
    # Not a union with the turned links, which would find all links twice.
    ways = [F.struct(F.col(a).alias("old"), F.col(b).alias("other")) for a, b in (("left", "right"), ("right", "left"))]
    both = storage.staged(links.select(F.inline(F.array(*ways))), "links")
    labels = storage.staged(both.groupBy("old").agg(F.least("old", F.min("other")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("old").alias("other"), "component"), "other").groupBy("old")
        spread = heard.agg(F.min("component").alias("heard")).join(labels, "old")
        spread = spread.select("old", F.least("heard", "component").alias("near"), F.col("component").alias("was"))
        ahead = labels.select(F.col("old").alias("near"), F.col("component").alias("far"))
        after = storage.staged(
            spread.join(ahead, "near", "left").select("old", F.least("near", "far").alias("component"), "was"), "labels"
        )
        changed = not after.where("component < was").isEmpty()
        storage.drop(labels)
        labels = after.select("old", "component")
        if not changed:
            return labels


def components(documents: DataFrame, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets are linked: 100 * intersection >= percent * union, on full sets.

    Words are lower-cased (A-Z) and separated by ASCII white space; a shingle is five of them, and a text of one to four
    words is one shingle. Returns a row for each input row: doc_id, n_shingles, component_id (smallest doc_id that can
    be reached over links), kept (doc_id is component_id).

    Null, empty or blank texts have an empty set and are linked with nothing. A row without doc_id is linked with
    nothing either: its component_id is null and it is kept. Rows that repeat a doc_id are versions of one document, so
    they share a component. An empty table gives an empty table. Other columns are ignored.
    """
    storage.small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketches = storage.staged(
        texts.withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(_sketches, "doc_id string, size long, sum1 long, sum2 long, tokens binary")
        .withColumn("doc_id", F.col("doc_id").cast("long")),
        "sketches",
    )
    key = ["size", "sum1", "sum2"]
    named = sketches.where("size > 0 and doc_id is not null")
    first = storage.staged(named.groupBy(key).agg(F.min("doc_id").alias("class")), "classes")
    tokens = named.withColumnRenamed("doc_id", "class").dropDuplicates(["class", *key])
    classes = storage.staged(
        first.join(tokens, ["class", *key]).select("class", "tokens", F.col("class").alias("component")), "components"
    )
    contents = texts.withColumnRenamed("doc_id", "class")
    count = _trees(percent)
    for trees in (range(0, FIRST), range(FIRST, count)):
        leaves, large = _nodes(classes, trees)
        nodes = storage.staged(leaves.unionByName(_blocks(large)), "members")
        classes = _merged(classes, _links(nodes, classes, contents, percent))
    _, large = _nodes(classes, range(0, count))
    if not large.isEmpty():
        nodes = storage.staged(_block_pairs(large), "members")
        classes = _merged(classes, _links(nodes, classes, contents, percent))
    by_set = first.join(classes.select("class", "component"), "class")
    found = named.select("doc_id", *key).join(by_set, key)
    versions = found.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sketches.select("doc_id", F.col("size").alias("n_shingles")).join(versions, "doc_id", "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return out.select(
        "doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with the components that the links leave."""
    renamed = connected(links).select(F.col("old").alias("component"), F.col("component").alias("new"))
    return storage.staged(
        classes.join(renamed, "component", "left").select("class", "tokens", F.coalesce("new", "component").alias("component")),
        "components",
    )


def representatives(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component one row of the smallest doc_id; all columns stay.

    Of rows with that doc_id, the one whose text has the smallest hash stays. Rows without doc_id take part under a name
    made from their text, greater than other doc_ids, and come back without one. Those with nothing but white space are
    like nothing and all stay.
    """
    near, row = storage.unused(documents, "_near_id"), storage.unused(documents, "_near_row")
    spare = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    named = documents.withColumn(near, F.coalesce(F.col("doc_id").cast("long"), spare))
    blank = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    full = named.where(~blank)
    found = components(full.select(F.col(near).alias("doc_id"), "text"), percent).where("kept")
    first = Window.partitionBy(near).orderBy(F.xxhash64("text"), "text")
    rows = full.join(found.select(F.col("doc_id").alias(near)).distinct(), near, "left_semi")
    kept = rows.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    return kept.select(documents.columns).unionByName(named.where(blank).select(documents.columns))
