"""What larger tables bring: odd rows, and steps that must not grow faster than their input."""

from __future__ import annotations

import random
import unicodedata

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from sitometra.config import LinkOptions
from sitometra.functions import text
from sitometra.operators import link, stats
from sitometra.plans.queries import ORACLE_SQL, QUERIES
from sitometra.sources import xml


def _rows(spark, tmp_path, name, table, rows, schema):
    """The rows of a query over one hand-made table, and those of its SQL, by their first column."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    want = duckdb.sql(ORACLE_SQL[name].replace(f"FROM {table}", f"FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')"))
    key = lambda r: str(r[0])
    return sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key), sorted(want.fetchall(), key=key)


TEXTS = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, " two  words \n"), (6, "a b\tc  ")]


def test_texts_without_a_token(spark, tmp_path):
    got, want = _rows(spark, tmp_path, "tokens_positions", "documents", TEXTS, "doc_id long, text string")
    assert got == want
    assert got[1][1:] == (0, None, None, -1)


def _values(spark, n=3000):
    return spark.range(n).select((F.col("id") % 3).cast("string").alias("k"), (1 + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("x"))


def test_quantiles_write_their_values_once(spark, monkeypatch):
    sizes, cut = [], stats.cut
    monkeypatch.setattr(stats, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    stats.robust_summary(_values(spark), "x", ["k"], 1.5, (0.05, 0.95), held=0).collect()
    # All else that is written is a row for each group and wanted rank at most.
    assert sorted(sizes)[-1] == 3000 and sorted(sizes)[-2] <= 3 * 6


def test_normal_forms_are_those_of_python(spark):
    every = [chr(c) for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["", "ἈΡΤΑΒΩ͂Ν  ﬁ ½ ß\x1f\x1cΣΊΤΟΣ 　", " \t ", "a ́b  çͅ", *("x" + "".join(every[i : i + 40]) for i in range(0, len(every), 40))]
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", text.strip_accents("t").alias("a"), text.normalize_for_search("t").alias("b"), text.norm_greek("t").alias("c"))
    for t, a, b, c in rows.collect():
        t = t or ""
        assert (a, b, c) == (bare(t), bare(" ".join(nfkc(t).split())).casefold(), " ".join(bare(nfkc(t)).casefold().split()))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_events_of_odd_texts(spark):
    texts = [None, "", "  πυρου  αρταβαι 3\n1/2 δραχμαι\t4/0 ", "πυρου αρταβαι 3 1/2 δραχμαι 4 1/0 1/4", "12 1/2 1/3 αρταβων"]
    rows = link.events(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value_norm string")).orderBy("i").collect()
    assert [[e.tok for e in r.grains] for r in rows] == [[], [], [0], [0], []]
    assert [[(e.tok, round(e.value, 6), e.word) for e in r.qtys] for r in rows] == [[], [], [(1, 3.5, "αρταβαι")], [(1, 3.5, "αρταβαι")], [(0, 12.833333, "αρταβων"), (2, 0.333333, "αρταβων")]]
    assert [[(e.tok, round(e.value, 6)) for e in r.prices] for r in rows] == [[], [], [(2, 3.5), (4, 4.0), (3, 0.5), (4, 0.0)], [(2, 3.5), (4, 4.25), (3, 0.5)], []]


def _chosen(rows):
    """Brute force of the greedy choice: one pass over a mention's candidates, best first."""
    used, taken = set(), {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["qty_tok"] is None, r["span"], r["d_gp"], 999_999 if r["d_pw"] is None else r["d_pw"], r["price_tok"], r["Grain_Index"], r["rank"])):
        if r["Grain_Index"] not in taken and (r["price_tok"] not in used or (r["score"] >= 80 and r["d_gp"] <= 12 and r["span"] <= 18)):
            taken[r["Grain_Index"]] = r["rank"]
            used.add(r["price_tok"])
    return {(r["Grain_Index"], r["rank"]): taken.get(r["Grain_Index"], 1) for r in rows}


def _competing(spark):
    rng = random.Random(5)
    rows = []
    for m in range(40):
        for g in range(1, rng.randint(1, 5) + 1):
            for k in range(1, rng.randint(1, 6) + 1):
                rows.append((m, g, k, float(rng.choice([60, 70, 79, 80, 90])), rng.choice([None, 1, 2]), rng.randint(1, 25), rng.randint(1, 14), rng.choice([None, 1, 3]), rng.randint(1, 4)))
    return spark.createDataFrame(rows, "m int, Grain_Index int, rank int, score double, qty_tok int, span int, d_gp int, d_pw int, price_tok int")


def test_greedy_choice_by_brute_force(spark):
    ranked = _competing(spark)
    by = {}
    for r in ranked.collect():
        by.setdefault(r["m"], []).append(r.asDict())
    want = {(m, g): pk for m, rows in by.items() for (g, _), pk in _chosen(rows).items()}
    chosen = link.primaries(ranked, ["m"])
    assert {(r.m, r.Grain_Index): r.primary_rank for r in chosen.collect()} == want and chosen.count() == len(want)
    # Folds in lambdas took most of the time.
    assert "aggregate(" not in chosen._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate", "")


def test_primaries_are_marked_without_making_candidates_twice(spark):
    ranked = _competing(spark)
    by = {}
    for r in ranked.collect():
        by.setdefault(r["m"], []).append(r.asDict())
    want = {(m, g, k): k == pk for m, rows in by.items() for (g, k), pk in _chosen(rows).items()}
    marked = link.with_primary(ranked, ["m"], LinkOptions(global_assign=True))
    assert marked.columns == [*ranked.columns, "is_primary"]
    assert {(r.m, r.Grain_Index, r["rank"]): r.is_primary for r in marked.collect()} == want and marked.count() == ranked.count()
    assert "Join" not in marked._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_found_once_and_candidates_stay_where_they_are(spark):
    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for name in ("event_extract", "nearest_priceword", "band_join_candidates", "confidence_score", "mention_amounts"):
        assert plan(name).count("Exchange ") == 1 and plan(name).count("ArrowEvalPython") == 1
    for name in ("rank_topk", "ambiguity_lead"):
        assert plan(name).count("Exchange ") == 2 and plan(name).count("ArrowEvalPython") == 1
    for name in ("greedy_primary", "emit_policy", "emit_primary"):
        assert plan(name).count("Exchange ") == 2 and plan(name).count("ArrowEvalPython") == 2


def test_few_files_are_held_at_once():
    class Files:
        select = lambda self, *c: self

        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    n = 3 * xml._FILES + 7
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([b"<a/>"] * (n - 1) + [b"<a>"])], ["path", "content"])
    sizes = [x.num_rows for x in xml.parse_status(Files())(iter([batch]))]
    assert sizes == [xml._FILES] * 3 + [7]
