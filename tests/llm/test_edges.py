"""Clashing column names, edge tables and verdicts of the operators and the pipeline's stages."""

import math
import os
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import bpe, chat, common, decontaminate, ngram_join, quality, sharding, substrings, token_orc, warc

LONG = " ".join(f"l{i}" for i in range(40_000))
PASSAGE = " ".join(f"w{i}" for i in range(60))
NAMES = "_text string, _own string, _stratum string, _begins string, _id string, _copy string, _leak string, n_words int, kept int, range_id int, Class int, copy int, leak int, broken string, own_stratum int, `a b` int"


@pytest.fixture(scope="module")
def crowded(spark):
    rest = ("x",) * 7 + (1, 2, 3, 4, 5, 6) + ("y", 7, 8)
    rows = [(1, f"{PASSAGE} one two"), (2, f"{PASSAGE} one two"), (3, None), (4, ""), (5, LONG), (None, PASSAGE), (6, f"zero {PASSAGE} end"), (6, f"zero {PASSAGE} end")]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s", 9, *rest) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, f"it holds {PASSAGE}"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name,kept", [("quality", [1, 2, None, 5, 6, 6]), ("near_duplicates", [1, 3, 4, 5, None]), ("repeated_substrings", [1, 2, 3, 4, 5, None, 6, 6]), ("decontamination", [3, 4, 5, None])])
def test_stages_with_clashing_names(spark, crowded, folder, name, kept):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, crowded, folder)
    assert got.columns == crowded.columns and [f.dataType for f in got.schema] == [f.dataType for f in crowded.schema]
    rows = got.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted(kept, key=str) and all(r["a b"] == 8 and r._begins == "x" for r in rows)
    none = common.materialize(crowded.filter("doc_id = -1"), "none")
    assert stage(spark, none, folder).count() == 0
    if name == "repeated_substrings":
        assert {r.text for r in rows if r.doc_id == 6} == {"zero end"} and {r.text for r in rows if r.doc_id == 2} == {""}


def test_pipeline_without_rows(spark, crowded, folder, tmp_path):
    crowded.filter("doc_id = -1").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_cutoffs(rows, good):
    """Cutoffs from the definition: (lang, text) of good documents once each, exact tails from binomial coefficients."""
    held = defaultdict(set)
    for i, lang, text in rows:
        if i in good:
            held[lang or ""].add(text)
    out, strata = {}, {s: [dict(zip(quality.COUNTS, quality.text_counts(t))) for t in ts] for s, ts in held.items()}
    strata = {s: [c for c in cs if c["n_words"] >= 50 and 2 * c["n_repeat_words"] <= c["n_words"]] for s, cs in strata.items()}
    strata = {s: cs for s, cs in strata.items() if cs}
    for s, cs in strata.items():
        for rule, cutoffs in quality.RULES.items():
            a, b = quality.SCORES[rule]
            for c in cutoffs:
                k, n, p = sum(x[a] / max(x[b], 1) > c for x in cs), len(cs), quality.ALPHA / len(quality.RULES)
                if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > quality.DELTA / (len(strata) * len(quality.RULES)):
                    break
                out[s, rule] = c
    return out


def test_quality_verdicts_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(2400):
        words = [f"g{i}x{j}" for j in range(60)]
        for j in rng.choice(60, int(rng.integers(0, 3 if i % 7 else 30)), replace=False):
            words[j] = ["###", "LOUD", "so!!", "$"][int(rng.integers(4))]
        rows.append((i, ["en", "fr", None][i % 3], " ".join(words)))
        if i % 2 or i < 1800:
            labels += [(i, int(i % 7 != 0))] * (1 + 3 * (i % 5 == 0))
    labels += [(9, 0), (9, 1), (None, 1), (99_999, 1)]
    docs, table = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    good = {i for i, _ in labels} - {i for i, q in labels if q == 0}
    want = brute_cutoffs(rows, good)
    assert {(r.stratum, r.rule): r.cutoff for r in quality.fit_cutoffs(docs, table).collect()} == want and len(want) > 4
    kept = {r.doc_id: r.kept for r in quality.judge(docs, table).collect()}
    for i, lang, text in rows:
        c = dict(zip(quality.COUNTS, quality.text_counts(text)))
        broken = any(c[a] / max(c[b], 1) > want.get((lang or "", rule), math.inf) for rule, (a, b) in quality.SCORES.items())
        assert kept[i] == (c["n_words"] >= 50 and 2 * c["n_repeat_words"] <= c["n_words"] and not broken)


def test_repeated_labels_certify_nothing_more(spark):
    docs = spark.createDataFrame([(i, "en", " ".join(f"g{i}x{j}" for j in range(60))) for i in range(40)], "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    many = labels.crossJoin(spark.range(30)).drop("id")
    assert quality.fit_cutoffs(docs, labels).count() == quality.fit_cutoffs(docs, many).count() == 0
    copies = docs.crossJoin(spark.range(30)).select((F.col("doc_id") * 100 + F.col("id")).alias("doc_id"), "lang", "text")
    assert quality.fit_cutoffs(copies, copies.select("doc_id", F.lit(1).alias("quality"))).count() == 0


def test_token_files_have_stripes_indexes_and_filters(spark, monkeypatch):
    monkeypatch.setattr(token_orc, "ORC", token_orc.ORC | {"orc.stripe.size": "16384", "orc.row.index.stride": "1000", "orc.rows.between.memory.checks": "100"})
    docs = spark.range(0, 40_000, 2, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.md5(F.col("id").cast("string"))).alias("text"))
    path = common.scratch_path(spark, "tokens")
    token_orc.write_tokens(docs, path, P.path("byte_bpe_50k.json"))
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".orc")]
    assert max(pyarrow.orc.ORCFile(f).nstripes for f in files) > 1
    meta = spark._jvm.org.apache.orc.OrcFile
    reader = meta.createReader(spark._jvm.org.apache.hadoop.fs.Path(files[0]), meta.readerOptions(spark._jsc.hadoopConfiguration()))
    kinds = set()
    for stripe in reader.getStripes():
        footer = reader.rows().readStripeFooter(stripe) if hasattr(reader.rows(), "readStripeFooter") else None
        kinds |= {str(s.getKind()) for s in footer.getStreamsList()} if footer else set()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    found = token_orc.lookup(spark, path, [20_000, 20_001])
    assert [r.doc_id for r in found.collect()] == [20_000]
    assert scanned(found) < 20_000 / 4
    assert scanned(token_orc.lookup(spark, path, [-5])) == 0


def scanned(df) -> int:
    """Rows that the scan of df gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_hot_shingles_come_last_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(60):
        words = [f"t{k}" for k in range(90)]
        for k in rng.choice(90, int(rng.integers(0, 4)), replace=False):
            words[k] = f"e{c}_{k}"
        rows.append((c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.link(docs).collect()))
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 8)
    joined = ngram_join.NgramJoin(docs)
    assert sorted(map(tuple, joined.result().collect())) == want and len(joined.hot_keys()) > 10


def test_automata_decide(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"a {PASSAGE} b"), (2, f"c {PASSAGE} d")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeated(docs).collect()} == {1: 0, 2: 60}
    automaton = substrings.automaton_of(["w1 w2", "b c"])
    assert substrings.locate(automaton, "w1 w2 xw1 w2 w1 w2 b c".split()).tolist() == [0, 4, 6]
    assert substrings.locate(substrings.automaton_of(["no such"]), PASSAGE.split()).tolist() == []


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: sharding.assign_shards(d, "doc_id", F.octet_length("text"), 100),
        lambda d: chat.digests(chat.format_conversations(d.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text"))),
        lambda d: token_orc.encode_and_index(d, P.path("byte_bpe_50k.json")),
        lambda d: bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        lambda d: warc.archive_and_read(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
        lambda d: quality.judge(d, d.select("doc_id", F.lit(1).alias("quality"))),
        lambda d: decontaminate.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
        lambda d: ngram_join.link(d),
        lambda d: substrings.remove_repeated(d),
    ],
)
def test_empty_tables(crowded, apply):
    assert apply(crowded.filter("doc_id = -1")).count() == 0


def test_very_long_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG * 5)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(turns)).first().loss_chars == 5 * len(LONG)


def test_all_labels_count_beyond_the_broadcast(spark, monkeypatch):
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(60)) + " #" * (i % 3)
    docs = spark.createDataFrame([(i, "en", text(i)) for i in range(800)], "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, 1).otherwise(0).alias("quality"))
    want = sorted(map(tuple, quality.fit_cutoffs(docs, labels).collect()))
    monkeypatch.setattr(quality, "MAX_LABELS", 40)
    assert sorted(map(tuple, quality.fit_cutoffs(docs, labels).collect())) == want and want
