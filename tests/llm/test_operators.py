"""Operators against plain versions, round trips and held-out labels, on small tables with the awkward cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from headwise.llm import (
    chat_format,
    decontaminate,
    language_id,
    line_dedup,
    near_dedup,
    quality_rules,
    source_mix,
    storage,
    substring_dedup,
    token_files,
    toxicity,
    training,
)

SF_DIR = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample_texts(seed: int = 1, n: int = 40) -> list[str | None]:
    """Null, empty and blank texts, copies, near copies, runs, and passages inside other texts."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(3000)}" for _ in range(120)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "One  TWO", "a " * 90, "b " + "a " * 50, "x y " * 60]
    texts += [" ".join(base)] * 3
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["start " + " ".join(base[20:80]) + " end", " ".join(str(i) for i in range(5000))]
    return texts


def table(spark, texts, **columns):
    """Documents with a null doc_id, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_chars": F.lit(None).cast("long"), "lang": F.lit("en"), "block": F.lit("b"), "name": F.lit(1)} | columns)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def plain_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)  # large nodes, blocks and pairs of blocks occur
    texts = sample_texts()
    got = near_dedup.components(table(spark, texts), percent=85)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain_components(list(enumerate(texts)), 85)


def test_stages_of_the_pipeline_equal_plain_versions(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    base = [f"v{rnd.randrange(3000)}" for _ in range(60)]
    texts = [" ".join(rnd.choices(base, k=40)) for _ in range(60)]
    for i in range(0, 40, 2):
        texts[i] += " blockhead"
    passage = " ".join(f"q{i}" for i in range(30))
    ids = list(range(60))
    add = [(60, texts[51] + " z"), (61, passage + " end"), (51, texts[51]), (62, None), (None, texts[53]), (None, "a b c d e f g"), (None, "a b c d e f g"), (None, " "), (None, None)]
    rows = [*zip(ids, texts, strict=True), *add]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 40 and i % 2 == 0)) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps, have = dict(corpus_pipeline.STAGES), docs
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = rows
    plain = {
        "toxicity": lambda rows: [r for r in rows if "blockhead" not in (r[1] or "")],
        "minhash_near_dedup": distinct_documents,
        "benchmark_decontamination": lambda rows: [r for r in rows if passage not in (r[1] or "")],
    }
    for name, of in plain.items():
        have, want = storage.staged(steps[name](spark, have, str(tmp_path)), name), of(want)
        assert have.columns == docs.columns and pairs(have) == sorted(want, key=str), name
    mixed = storage.staged(steps["source_mixing"](spark, have, str(tmp_path)), "mixed")
    times = Counter({})
    for r in source_mix.mix(have).collect():
        times[r.doc_id, r.text] += r.copies
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +times
    ids_of = token_files.tokenizer(TOKENIZER).library
    got = steps["token_ids"](spark, mixed, str(tmp_path)).collect()
    crc = lambda t: zlib.crc32(np.array([*ids_of.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r.doc_id, crc(r.text)) for r in mixed.collect())


def distinct_documents(rows):
    """One row of each group of near duplicates, those with an id first; blank rows without id stay."""
    kept = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        a = shingles(t)
        if not any(i == j is not None or a and 100 * len(a & shingles(u)) >= 80 * len(a | shingles(u)) for j, u in kept):
            kept.append((i, t))
    return kept


def test_near_duplicates_of_nothing_and_without_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(near_dedup.components(rows).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None, True)] * 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 3] == [(3, True)] * 2


def test_near_duplicates_are_compared_once_and_only_their_texts_are_moved(spark, monkeypatch):
    kept, compared = (spark.sparkContext.accumulator(0) for _ in range(2))
    candidates, compare, among, passed = near_dedup._candidates, near_dedup._compare, near_dedup._among, []

    def counted(make, total, of):
        def made(percent):
            inner = make(percent)

            def call(rows: pd.DataFrame) -> pd.DataFrame:
                out = inner(rows)
                total.add(len(of(rows, out)))
                return out

            return call

        return made

    monkeypatch.setattr(near_dedup, "_candidates", counted(candidates, kept, lambda rows, out: out))
    monkeypatch.setattr(near_dedup, "_compare", counted(compare, compared, lambda rows, out: rows))
    monkeypatch.setattr(near_dedup, "_among", lambda rows, names: passed.append(found := among(rows, names)) or found)
    rnd = random.Random(4)
    alone = [" ".join(str(rnd.randrange(10**9)) for _ in range(30)) for _ in range(400)]
    texts = sample_texts() + alone
    got = near_dedup.components(table(spark, texts), percent=85)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain_components(list(enumerate(texts)), 85)
    assert 0 < compared.value == kept.value
    assert passed and all(found.count() < 150 for found in passed)


def test_texts_among_names(spark, monkeypatch):
    rows = spark.range(-3, 20_000).select(F.col("id").alias("class"), F.lit("x").alias("text"))
    names = rows.where("class % 10 = 0").select("class")
    for most, others in ((1 << 28, 2000), (1 << 15, 20_000)):  # enough bits, and a filter that is full at one page
        monkeypatch.setattr(near_dedup, "MOST_BITS", most)
        found = near_dedup._among(rows, names)
        assert found.columns == ["class", "text"] and found.join(names, "class").count() == names.count()
        assert found.count() == found.distinct().count() < names.count() + others
    assert near_dedup._among(rows, names.limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, "x"), (7, "y")], "class long, text string")
    assert [r.text for r in near_dedup._among(unnamed, spark.createDataFrame([(7,)], "class long")).collect()][-1] == "y"


@pytest.mark.parametrize(("percent", "trees"), [(80, 11), (85, 8)])
def test_large_nodes_of_every_tree_are_compared(spark, monkeypatch, percent, trees):
    assert near_dedup._trees(percent) == trees and (1 - (percent / 100) ** 3) ** trees <= near_dedup.MISS
    seen = []
    nodes, pairs = near_dedup._nodes, near_dedup._block_pairs
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "_nodes", lambda classes, some: seen.append(some) or nodes(classes, some))
    monkeypatch.setattr(near_dedup, "_block_pairs", lambda large: seen.append("pairs") or pairs(large))
    near_dedup.components(table(spark, sample_texts(n=20)), percent=percent)
    assert [x for x in seen if x != "pairs"][-1] == range(trees)
    assert sorted(i for x in seen[:2] for i in x) == list(range(trees))


def test_pairs_of_the_least_similarity_pass_the_gate():
    assert [near_dedup._agree(p) for p in (80, 85, 100)] == [38, 42, 64]
    rng, passed = np.random.default_rng(3), 0
    for _ in range(3000):  # sets of 1,000 with 800 of 1,000 in common with the union
        union = rng.integers(0, 1 << 63, 1000, np.uint64)
        node = pd.DataFrame({"tokens": [near_dedup._tokens(union), near_dedup._tokens(union[:800])], "component": [0, 1]})
        passed += sum(len(near) for _, near in near_dedup._alike(node, near_dedup._agree(80)))
    assert passed >= 2998  # a gate of 42, made for 0.85, loses about seven


def test_repeats_equal_counted_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", 3000)
    texts = sample_texts(2, 12)
    words = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = {}
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    df = table(spark, texts)
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(df).collect()} == want
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 700)
    texts = sample_texts(3, 5) + ["It's <|endoftext|> 12,5 é è ế 　 Ü!!", "don't"]
    token_files.write(table(spark, texts), f"{tmp_path}/t", TOKENIZER)
    got = token_files.read(spark, f"{tmp_path}/t").orderBy("doc_id").collect()
    library, start = token_files.tokenizer(TOKENIZER).library, 0
    for row, text in zip(got, texts, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.start, bytes(row.ids)) == (start, np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_pieces_that_differ_in_case_and_signs_are_tokenized_once(monkeypatch):
    tokens, asked = token_files.Tokenizer(TOKENIZER), []
    compute = tokens.memo.compute
    monkeypatch.setattr(tokens.memo, "compute", lambda names: asked.extend(names) or compute(names))
    texts = ["Été, thing (THING) thing! été: Thing's", "thing12, 21 \u2018thing\u2019 ÉTÉ", None, "été"]
    want = [[*tokens.library.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert [x.tolist() for x in tokens.encode(texts)] == want
    assert sorted(x if isinstance(x, str) else x.decode("utf-16-le") for x in asked) == sorted(
        ["été", "thing", "'s", "1", "2", ",", "(", ")", "!", ":", "\u2018", "\u2019"]
    )


def test_ids_are_the_library_s_wherever_texts_are_cut(monkeypatch):
    tokens, rnd = token_files.Tokenizer(TOKENIZER), random.Random(3)
    ends = "<|endoftext|> <|ENDOFTEXT|>x <|endof text|> <|startoftext|>"
    pools = ["'stremvldSTREMV aZ1!.,'", "aHTÉé\u0338\u0331\u0301 =<>'s", "\t\n\r\x0b\x1c\x85\xa0\u2003\u3000 ab1'", "İıſKÅΣσςǅẞß'S ",
             "\u2019\u2014\u2026 s'tre Xx", "汉字がか\u3099각\u11a8 a1'", "😀\u200d👍🏽é a'\ufe0f1"]
    texts = [ends, ends.replace("|", ""), *("".join(rnd.choices(rnd.choice(pools) + rnd.choice(pools), k=rnd.randrange(60))) for _ in range(3000))]
    want = [[*tokens.library.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    for together in (5, 100, 1 << 20):
        monkeypatch.setattr(token_files.Tokenizer, "TOGETHER", together)
        assert tokens.cuts and [x.tolist() for x in tokens.encode(texts)] == want


def test_a_tokenizer_that_keeps_spaces_gets_whole_texts():
    tokens = token_files.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one  two\nthree", None, "", " x"]
    want = [[*tokens.library.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert [x.tolist() for x in tokens.encode(texts)] == want


def test_blocks_decode_from_checkpoints_and_notice_damage():
    ids = np.random.default_rng(1).zipf(1.3, 300_000).astype(np.uint32) % 1000
    coder = token_files.Coder(token_files.normalised(np.bincount(ids, minlength=1001)))
    block = coder.encode(ids, np.array([100_000, 200_000]))
    assert (coder.decode(block)[0] == ids).all() and len(block) < 2 * len(ids)
    assert (coder.decode_from(block, 1) == ids[token_files.LANES * token_files.INTERVAL :]).all()
    with pytest.raises(ValueError):
        coder.decode(block[:-1] + bytes([block[-1] ^ 1]))
    empty = np.zeros(0, np.uint32)
    assert len(coder.decode(coder.encode(empty, np.zeros(0, int)))[0]) == 0 and zlib.crc32(b"") == 0


def test_quality_base_columns(spark):
    texts = [None, "", "a #b\na #b\n \n \n", "p q r s t " * 8, " ".join(map(str, range(40))), "k l m n o x k l m n o" + " y z" * 9]
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(table(spark, texts, kept=F.lit("?")), labels).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        held = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {j for k in range(len(words) - 4) if held[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        row = got[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_quality_names_windows_by_shorter_ones(spark):
    texts = ["", "a", "a b", "a b c d", "a b c d e", "p q r s t p q r s t u", "a b c d e f a b c d e g a b c d f"]
    words = quality_rules.words(F.col("text"))
    singles, doubles = quality_rules._singles(words), quality_rules._doubles(words)
    slices = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.slice(words, i, 2)))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", F.size(singles).alias("n"), doubles.alias("two"), quality_rules._held(singles, doubles).alias("five"),
        F.when(F.size(words) > 1, slices).otherwise(F.array().cast("array<long>")).alias("sliced"),
    )
    for row in rows.collect():
        own = WORD.findall(row.text)
        held = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
        assert (row.n, row.two, len(row.five)) == (len(own), row.sliced, len(held))
        assert [row.five.index(h) for h in row.five] == [held.index(h) for h in held]
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality_rules.judge(table(spark, texts), labels)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lambdafunction\([^\n]{0,40}slice\(", plan)  # no slice for each window


def test_language_is_told_for_held_out_documents(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("held_out", training.held_out(3, 1))
    model = language_id.train(documents.where("not held_out"))
    found = documents.where("held_out").select("lang", language_id.predict(F.col("text"), model).alias("p"))
    assert found.where("lang = p.lang_pred").count() >= 0.98 * found.count()
    odd = spark.createDataFrame([(None,), ("",), ("12 ,",)], "text string").select(language_id.predict(F.col("text"), model).alias("p"))
    assert {r.p.lang_pred for r in odd.collect()} == {"und"}


def test_toxicity_tolerates_inserted_characters(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("aeiounrst") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(240):
        words = rnd.choices(vocabulary, k=20)
        if i % 4 == 0:
            words.insert(7, rnd.choice(["blockhead", "dimwit"]))
        rows.append((i, " ".join(words) + ".", int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    cases = [("you blo-ckhead", 1), ("you bl0ckhhead!", 1), ("a d i m w i t", 1), (" ".join(vocabulary[:50]), 0), (None, 0), ("", 0)]
    scored = spark.createDataFrame(cases, "text string, want int").withColumn("score", toxicity.score(F.col("text"), model))
    assert all((r.score >= toxicity.THRESHOLD) == bool(r.want) for r in scored.collect())


def test_copies_leave_room_for_the_landmarks_of_others(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    vocabulary, long, passage = [word() for _ in range(300)], [word() for _ in range(400)], [word() for _ in range(60)]
    texts = [(rnd.choices(vocabulary, k=60), 0) for _ in range(150)]
    texts += [([*long, word()], 1) for _ in range(50)]  # near copies
    texts += [([*passage, *(word() for _ in range(150))], 1) for _ in range(40)]  # one passage in otherwise different texts
    texts += [([*rnd.choices(vocabulary, k=30), x], 1) for x in ("blockhead", "dimwit") for _ in range(15)]
    df = spark.createDataFrame([(i, " ".join(w) + ".", k) for i, (w, k) in enumerate(texts)], "doc_id long, text string, toxic int")
    found = toxicity._landmarks(df)
    assert {"^blockhead", "^dimwit"} <= set(found)
    assert not {x[1:] for x in found} & set(long)


def test_nothing_is_learned_from_labels_held_out(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from headwise.llm import queries

    df = spark.createDataFrame([(i, f"text {i}.") for i in range(40)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: seen.append(labels) or train(docs, labels))
    queries.toxic_documents(spark, str(tmp_path))
    corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    assert len(seen) == 2
    for labels in seen:
        ids = {r.doc_id for r in labels.collect()}
        assert ids == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_lines_and_empty_tables(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", None, "", "a\nb", "p\np\np\np"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_runs(table(spark, texts)).collect()}
    assert got == {0: ("a\nb\nc\nd", 4, 0), 1: ("x\ny", 5, 3), 2: (None, 0, 0), 3: ("", 1, 0), 4: ("a\nb", 2, 0), 5: ("p", 4, 3)}
    assert line_dedup.remove_runs(table(spark, texts).limit(0)).count() == 0


def plain_runs(texts, min_lines, min_chars):
    """Lines of each text that lie in no run which counts and occurred before."""
    seen, gone = set(), [set() for _ in texts]
    split = [[] if t is None else t.split("\n") for t in texts]
    for d, own in enumerate(split):
        for s in range(len(own)):
            for end in range(s + 1, len(own) + 1):
                run = tuple(own[s:end])
                if len(run) >= min_lines or sum(map(len, run)) >= min_chars:
                    if run in seen:
                        gone[d] |= set(range(s, end))
                    seen.add(run)
    return [None if t is None else "\n".join(x for i, x in enumerate(own) if i not in gone[d]) for d, (t, own) in enumerate(zip(texts, split, strict=True))]


@pytest.mark.parametrize(("min_lines", "min_chars"), [(3, 30), (1, 30), (2, 9), (4, 12), (3, 1000)])
def test_runs_go_as_in_plain_python(spark, min_lines, min_chars):
    """Runs of every length, against all runs of all texts; most lines are common."""
    rnd = random.Random(min_lines)
    kinds = ["", "", "a", "bb", "licence", "ünï cödé", "a line of more than thirty characters", "another one that is as long as that"]
    texts = ["\n".join(rnd.choice(kinds) + rnd.choice(["", "", str(rnd.randrange(99))]) for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    texts += [None, "", kinds[-1], kinds[-1], "licence\n" * 5]
    got = {r.doc_id: r.text for r in line_dedup.remove_runs(table(spark, texts), min_lines, min_chars).collect()}
    assert [got[i] for i in range(len(texts))] == plain_runs(texts, min_lines, min_chars)


def test_mix_stays_below_twice_and_repeats(spark):
    df = table(spark, sample_texts(4, 20), source=F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    first, again = (sorted(map(tuple, source_mix.mix(df).select("doc_id", "copies", "target").collect())) for _ in range(2))
    assert first == again and all(0 <= c <= 2 for _, c, _ in first)
    assert source_mix.emit(df).columns == df.columns and source_mix.mix(df.limit(0)).count() == 0


def test_contaminated_spans(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Tiny Item"), (None, "null id"), (3, None)], "item_id long, text string")
    texts = [f"Lead, {item.upper()}! tail", "so tiny, item here", "q1 q2 q3", None, ""]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.scan(table(spark, texts), bench).collect()}
    assert got == {0: (22, 20, ["1"]), 1: (4, 2, ["2"]), 2: (3, 0, []), 3: (0, 0, []), 4: (0, 0, [])}
    kept = {r.doc_id: r.text for r in decontaminate.without_spans(table(spark, texts), bench).collect()}
    assert kept == {0: "Lead, tail", 1: "so here", 2: "q1 q2 q3", 3: None, 4: ""}
    twice = table(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id"))).withColumns({x: F.lit(1) for x in ("_doc", "_TEXT", "_words", "_found", "_bad")})
    assert decontaminate.scan(twice, bench).where("n_hit > 0").count() == 2
    whole = decontaminate.without_documents(twice.unionByName(twice), bench)
    assert whole.columns == twice.columns
    assert sorted(map(str, (r.doc_id for r in whole.collect()))) == ["2", "2", "3", "3", "4", "4"]
    assert decontaminate.without_documents(twice.limit(0), bench).count() == 0


def test_words_back_off_to_shorter_grams_and_long_texts_are_read_in_parts(monkeypatch):
    model = language_id.Model(["a", "b"], {"known": 0}, {"<ne": 1, "e": 2, "w>": 3}, np.array([[1.0, 2], [3, 4], [5, 6], [7, 9]]))
    reader = language_id.Reader(model)
    once = reader.totals(["Known", "new", "known-new known", "zz", "12", "", None])
    assert np.allclose(once, [[1, 2, 1], [5, 19 / 3, 1], [7, 31 / 3, 3], [0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 0]])
    monkeypatch.setattr(language_id.Reader, "STEP", 7)
    texts = ["known new zz " * 20, "new", "known new zz " * 20]
    apart = language_id.Reader(model).totals(texts)
    assert np.allclose(apart, reader.totals(texts)) and apart[0].tolist() == apart[2].tolist()


def test_everyone_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (None, 0, None, "x"), (2, None, "ann", "late")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    text = {(r.conv_id, r.perspective): (r.text, r["mask"]) for r in got}
    assert text[1, "ann"][0] == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n"
    start, end = map(int, text[1, "ann"][1].split("-"))
    assert text[1, "ann"][0][start:end] == "hi<|end|>" and set(text) == {(1, "ann"), (1, "bob"), (2, "ann")}


def test_parts_of_many_rows_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_ROWS", 20)
    hot = [(None, i % 3, ("ann", "bob")[i % 2], f"text {i}") for i in range(300)]
    rows = [*hot, *[(7, 0, "ann", "same")] * 90, (7, 1, "bob", "x"), (8, 0, None, "y"), (8, 1, "cy", None)]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert max(r.n_turns for r in got) <= 60  # a place is drawn, so pieces differ in size
    assert {(r.conv_id, r.piece, r.n_turns) for r in got if r.conv_id} == {(7, 0, 2), (8, 0, 2)}
    for me in ("ann", "bob"):
        mine = sorted((r.piece, r.text) for r in got if r.conv_id is None and r.perspective == me)
        assert len(mine) >= 12 and len({k for k, _ in mine}) == len(mine)
        turns = [t for _, text in mine for t in re.findall(r"\n(text \d+)<", text)]
        assert sorted(turns) == sorted(t for _, _, _, t in hot)
        numbers = [{int(t[5:]) % 3 for t in re.findall(r"\n(text \d+)<", text)} for _, text in mine]
        assert all(max(a) <= min(b) for a, b in zip(numbers, numbers[1:]))


def test_staged_tables_can_be_dropped(spark):
    kept = storage.staged(spark.range(5), "five")
    assert kept.count() == 5
    storage.drop(kept)
