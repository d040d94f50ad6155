"""Deep pages, tiny sources, clashing columns, many reading tasks."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusspark.llm import common, exact_dedup, html_extract, mixing, near_copies, piece_sampling, warc

LLM = Path(common.__file__).parent


def test_comments_without_content_lose_no_text():
    model = html_extract.train_on_layouts(60)
    body = "<body><article><h1>Title of it</h1><p>{}First sentence here, long enough to be text. And another one.</p><p>Second paragraph, again with words.</p></article></body>"
    plain = [b.text for b in html_extract.blocks_of(body.format(""))]
    for comment in ("<!-->", "<!--->", "<!-- x -->", "<!-- x --!>", "<!---->"):
        assert [b.text for b in html_extract.blocks_of(body.format(comment))] == plain
    assert "Second paragraph" in html_extract.main_text(model, html_extract.Features(), body.format("<!-->"))


@pytest.mark.parametrize("unit", ['<div class="a b">x ', '<div class="c{}">y ', "<b>z ", "<p><span>w ", "<li><ul>v ", "</p></x>u <span>"])
def test_deep_pages_take_time_in_proportion(unit):
    page = "".join(unit.replace("{}", str(i)) for i in range(1_000_000 // len(unit)))
    started = time.time()
    blocks = html_extract.blocks_of(page)
    model = html_extract.Field(html_extract.np.zeros(html_extract.BUCKETS), html_extract.np.zeros((2, 2)), html_extract.np.array([0.0, 1.0]))
    html_extract.Features().scores(model.weights, blocks)
    assert time.time() - started < 20
    assert sum(len(b.text.replace(" ", "")) for b in blocks) == 1_000_000 // len(unit)


def test_scores_of_elements_equal_those_of_their_features():
    rng = random.Random(2)
    weight = [rng.random() for _ in range(html_extract.BUCKETS)]
    page = "<body><div class='main page'><p>one</p><div class='main'><a href=x>two</a><ul><li>three<li hidden>four</ul></div></div><footer id=foot>five<svg>no</svg></footer>"
    blocks, features = html_extract.blocks_of(page), html_extract.Features()
    assert [b.text for b in blocks] == ["one", "two", "three", "four", "five"]
    found = features.scores(weight, blocks)
    for i, b in enumerate(blocks):
        buckets = features.block(b, i, len(blocks))
        assert found[i] == pytest.approx(sum(weight[x] for x in buckets))
        assert len(b.above.names()) == len(set(b.above.names()))


def test_tiny_source_beside_a_huge_one(spark):
    docs = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 100, "huge")], "doc_id long, text string, source string")
    rates = spark.createDataFrame([("tiny", 1, 200_000.0), ("huge", 1, 0.5)], "source string, rows long, rate double")
    started = time.time()
    out = mixing.replicate(docs, rates).filter("source = 'tiny'")
    n, most, least, kinds, told = out.agg(F.count("*"), F.max("copy"), F.min("copy"), F.countDistinct("copy"), F.max("copies")).first()
    assert n == most == kinds == told and least == 1
    assert abs(n - 200_000) < 5 * 200_000**0.5
    assert time.time() - started < 60
    sizes = mixing.source_rates(spark.createDataFrame([(1, "x", "a"), (2, "y" * 3_000, "b")], docs.schema))
    assert {r.source: r.rate for r in sizes.collect()} == pytest.approx({"a": 1500.5, "b": 3001 / 6000})


def test_rates_in_parts_keep_mean_and_variance(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    rates = spark.createDataFrame([("a", 1500, 2500.0)], "source string, rows long, rate double")
    table = docs.crossJoin(rates.select(mixing.poisson_steps(F.lit(2500.0) / 3).alias("steps")))
    counts = [r[0] for r in table.select(mixing._copies(F.col("steps"), F.lit(3).cast("long"), [F.lit(0), F.col("doc_id")])).collect()]
    mean = sum(counts) / len(counts)
    assert abs(mean - 2500) < 5 * (2500 / 1500) ** 0.5
    assert 0.85 < sum((c - mean) ** 2 for c in counts) / len(counts) / 2500 < 1.15


def internal_names():
    """Every column name in quotes in this folder that starts with an underscore, and those the operators add."""
    found = {n for f in LLM.glob("*.py") for n in re.findall(r'"(_[a-z_]+\d?)"', f.read_text())}
    return sorted(found | {"_bucket0", "_bits0", "_bucket1", "_bits1", "piece_ids", "copy", "copies", "order_key", "rank", "lang_pred", "score", "class_id", "keep_id"})


def test_no_internal_name_clashes_with_a_column(spark):
    names = internal_names()
    assert {"_hot", "_maybe", "_place"} <= set(names)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 50)) for _ in range(30)), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [rows[0], (99, rows[1][1], "en", "a", 1), (98, rows[2][1] + " ", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = docs.select("*", *[F.lit(7).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        bare, wide = stage(spark, docs, ""), stage(spark, plain, "")
        kept = [c for c in bare.columns if c in docs.columns]
        assert sorted(map(tuple, bare.select(kept).collect())) == sorted(map(tuple, wide.select(kept).collect())), name
        assert wide.select(*[n for n in names]).distinct().collect() == [(7,) * len(names)], name
    assert exact_dedup.dedup_report(plain).count() == near_copies.near_copy_classes(plain).count() == len(rows)


def test_pieces_do_not_depend_on_the_table_size(spark, monkeypatch):
    """Words are filtered anew when a task's table is full; what is sampled stays the same."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("word"), (F.col("id") * 7 + i).cast("string")) for i in range(30)]).alias("text"))
    usual = {r.doc_id: r.piece_ids for r in piece_sampling.encode(docs).collect()}
    rows = docs.collect()
    words, found = piece_sampling.Words(piece_sampling._pieces(open(piece_sampling.MODEL, "rb").read(), piece_sampling.SHARPNESS)), {}
    monkeypatch.setattr(piece_sampling, "NODES", 500)
    monkeypatch.setattr(piece_sampling, "SLICE", 1000)
    for i, ids in piece_sampling._encoded(words, [r.doc_id for r in rows], [r.text for r in rows], 0):
        found[rows[i].doc_id] = ids.tolist()
    assert found == usual


def test_records_are_read_in_many_tasks(spark, tmp_path):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html"))
    back = warc.archive_round_trip(spark, pages, str(tmp_path / "w"))
    spread = back.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(spread) > 2 and sum(r["count"] for r in spread) == 3000 and max(r["count"] for r in spread) < 2000
    assert back.filter("not digest_ok").count() == 0
