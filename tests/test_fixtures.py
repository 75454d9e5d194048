"""Hand-made blocks and numbers with known results."""

import pytest
from pyspark.sql import functions as F

from sitometra.config import LinkOptions
from sitometra.functions import canon, numbers, text
from sitometra.operators import analyze, link, sample, stats
from sitometra.sources import xml

TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><idno type="ddb-hybrid">x;1</idno><div type="edition">{}</div></TEI>'
F1 = '<ab>τιμὴ πυροῦ ἀρταβῶν <num value="25">κε</num> δραχμαὶ <num value="300">τ</num></ab>'
F2 = '<ab>σίτου ἀρτάβης 𐅵 δραχμαὶ <num value="8">η</num></ab>'
F3 = '<ab>πυροῦ ἀρτ<ex>άβαι</ex> <num value="4">δ</num> δραχμαὶ <num value="16">ις</num></ab>'
F4 = '<ab>πυροῦ <num value="6">ϛ</num><lb n="2"/>ἀρτάβαι δραχμαὶ <num value="24">κδ</num></ab>'
F5 = '<ab><l>πυροῦ ἀρτάβη <num value="1">α</num></l><l>τιμὴ δραχμῶν <num value="9">θ</num></l></ab>'


def found(spark, body, options=LinkOptions()):
    files = spark.createDataFrame([("/c/a.xml", bytearray(TEI.format(body).encode()))], "path string, content binary")
    blocks = xml.parse_blocks(files).withColumnRenamed("ddb_id", "DDB_ID")
    return link.find_mentions(blocks.select("*", *[F.lit("").alias(c) for c in link.META]), options)


@pytest.mark.parametrize(
    ("body", "norm", "grains", "qtys", "prices", "pricewords"),
    [
        (F1, "τιμη πυρου αρταβων 25 δραχμαι 300", [1], [(2, 25)], [(3, 25), (4, 300)], [0]),
        (F2, "σιτου αρταβησ 1/2 δραχμαι 8", [0], [(1, 1), (1, 0.5)], [(2, 2), (3, 8), (2, 0.5)], []),
        (F3, "πυρου αρτ αβαι 4 δραχμαι 16", [0], [], [(3, 4), (4, 16)], []),
        (F4, "πυρου 6 __lb__ αρταβαι δραχμαι 24", [0], [], [(4, 24)], []),
        (F5, "πυρου αρταβη 1 τιμη δραχμων 9", [0], [(1, 1)], [(4, 9)], [3]),
    ],
)
def test_events(spark, body, norm, grains, qtys, prices, pricewords):
    rows = found(spark, body).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.value_norm == norm
    assert [g.tok for g in r.grains] == grains
    assert [(q.tok, q.value) for q in r.qtys] == qtys
    assert [(p.tok, p.value) for p in r.prices] == prices
    assert [w.tok for w in r.pricewords] == pricewords


def test_scores_and_rows(spark):
    rows = found(spark, F1)
    ranked = link.rank(link.candidates(rows), ["DDB_ID", "path", "Mention_ID"]).orderBy("rank").collect()
    assert [round(r.score, 5) for r in ranked] == pytest.approx([81.847348, 77.789586, 62.578907, 58.521145], abs=1e-5)
    out = link.link(rows).collect()
    assert len(out) == 1 and len(out[0]) == 28
    assert (out[0].Ambiguous, out[0].AltScore, out[0].Price_Value, out[0].Lines_Crossed) == ("yes", "77.79", "25", 0)
    assert len(link.mention_rows(rows).columns) == 21


def test_line_penalty_option(spark):
    body = '<ab>τιμὴ πυροῦ<lb n="2"/>ἀρταβῶν <num value="25">κε</num> δραχμαὶ</ab>'
    rows = link.candidates(found(spark, body), line_penalty="fixed").collect()
    assert {r.lines for r in rows if r.high >= 2 and r.low <= 2} == {1}
    assert {r.lines for r in link.candidates(found(spark, body)).collect()} == {0}


def test_primary_below_topk_is_not_emitted(spark):
    schema = "m int, Grain_Index int, rank int, score double, qty_tok int, span int, d_gp int, d_pw int, price_tok int"
    rows = spark.createDataFrame([(1, 1, 1, 79.0, 2, 5, 5, 1, 7), (1, 2, 1, 78.0, 2, 5, 5, 1, 7), (1, 2, 2, 70.0, 2, 5, 5, 1, 9), (1, 3, 1, 60.0, 2, 5, 5, 1, 7)], schema)
    got = {r.Grain_Index: r.primary_rank for r in link.primaries(rows, ["m"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    marked = link.with_primary(rows, ["m"], LinkOptions(global_assign=True))
    assert link.emit(marked, LinkOptions(topk=1)).where("Grain_Index = 2 and is_primary").count() == 0
    assert link.emit(marked, LinkOptions(topk=1, emit_topk_and_primary_only=True)).where("Grain_Index = 2 and is_primary").count() == 1
    assert link.emit(marked, LinkOptions(emit_only_primary=True)).count() == 3


def test_malformed_files(spark):
    files = spark.createDataFrame([("/a.xml", bytearray(b"<a>")), ("/b.xml", bytearray(b"<a/>"))], "path string, content binary")
    assert xml.parse_blocks(files).count() == 0
    assert {r.path: r.parsed for r in xml.parse_status(files).collect()} == {"/a.xml": False, "/b.xml": True}


def test_robust_summary(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (2, 3, 4, 5, 6, 1000)] + [(2, -1.0), (3, 5.0)], "g int, y double")
    got = {r.g: r for r in stats.robust_summary(rows, "y", ["g"]).collect()}
    assert got[1].n == 5 and got[1].median == pytest.approx(4) and got[1].q25 == pytest.approx(3) and got[1].q75 == pytest.approx(5)
    assert 2 not in got and got[3].n == 1


def test_score_bins(spark):
    rows = spark.createDataFrame([(10.0,), (10.5,), (11.0,), (20.5,), (21.0,), (80.0,), (-1.0,), (80.5,), (float("nan"),)], "s double")
    got = [r[0] for r in rows.select(numbers.score_bin(F.col("s"))).collect()]
    assert got == ["00-10", "01-10", "11-20", "11-20", "21-30", "71-80", None, None, None]
    assert "01-10" not in numbers.bins(80)


def test_years(spark):
    rows = spark.createDataFrame([("0134-05-29", "", ""), ("", "-0029", ""), ("", "100", "151"), ("", "", "")], "w string, b string, a string")
    year = numbers.infer_year(F.col("w"), F.col("b"), F.col("a"))
    got = [tuple(r) for r in rows.select(year, numbers.year_bin(year)).collect()]
    assert got == [(134.0, 125), (-29.0, -50), (125.5, 125), (None, None)]


def test_rolling_median(spark):
    rows = spark.createDataFrame([(1, 1.0), (5, 2.0), (6, 9.0)], "k int, m double")
    assert [r.median_smooth for r in stats.rolling_median(rows, "m", "k", []).orderBy("k").collect()] == [1.5, 2.0, 5.5]


def test_tiers(spark):
    rows = spark.createDataFrame([(65.0, False), (65.0, True), (60.0, False), (59.99, False), (None, False)], "s double, a boolean")
    assert [r[0] for r in rows.select(numbers.quality_tier(F.col("s"), F.col("a"))).collect()] == ["A", "B", "B", "C", "C"]


def test_index_has_its_base_at_100(spark):
    rows = spark.createDataFrame([(25, 9.0, 9.0), (50, 2.0, 2.0), (75, 4.0, 4.0)], "YearBin int, median double, median_smooth double")
    got = {r.YearBin: r.price_index for r in stats.price_index(rows, "YearBin", 50, 99).collect()}
    assert (got[50] + got[75]) / 2 == pytest.approx(100)
    assert [r.price_index for r in stats.price_index(rows, "YearBin", 500, 599).collect()] == [None] * 3


def test_outliers_with_no_spread(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0), (None, 2.0)], "g string, v double")
    got = stats.group_outliers(rows, "v", ["g"], "P").collect()
    assert len(got) == 4 and not any(r.P_IsOutlier for r in got) and all(r.P_GroupZ is None for r in got)


def test_sampling(spark):
    rows = spark.createDataFrame([(str(i), str(i % 81), "yes" if i % 3 else "no", "yes") for i in range(400)], "DDB_ID string, Score string, Ambiguous string, Is_Primary string")
    few = sample.sample_rows(rows, ["DDB_ID"], per_bin=4).collect()
    assert len(few) == 8 * 4 and {r.Human_Label for r in few} == {""}
    assert few == sample.sample_rows(rows, ["DDB_ID"], per_bin=4).collect()
    lopsided = rows.where("Ambiguous = 'no'")
    assert sample.sample_rows(lopsided, ["DDB_ID"], per_bin=4).count() == 8 * 2
    assert sample.sample_rows(lopsided, ["DDB_ID"], per_bin=4, fill=True).count() == 8 * 4


def test_primary_cascade(spark):
    rows = spark.createDataFrame([("a", "1", "1", "2", "no", "50"), ("a", "1", "1", "1", "no", "70")], "DDB_ID string, Mention_ID string, Grain_Index string, Candidate_Rank string, Is_Primary string, Score string")
    assert [r.Score for r in analyze.select_primary(rows).collect()] == ["70"]
    assert analyze.select_primary(rows.drop("Candidate_Rank")).count() == 1
    assert analyze.select_primary(rows.drop("Candidate_Rank", "Score")).count() == 2


def test_numbers_and_text(spark):
    one = spark.range(1)
    got = one.select(
        numbers.to_float(F.lit("1/4")), numbers.to_float(F.lit("1/0")), numbers.to_float(F.lit("1d")), numbers.to_float(F.lit(" ")), numbers.to_num(F.lit("nan")),
        text.format_fraction(F.lit(0.5)), text.format_fraction(F.lit(3.0)), text.clean_context(F.lit("a \r\n  b\t c ")), canon.place(F.lit("theban oxyrhynchus")), text.ordered_join(F.array(F.lit("b"), F.lit("a"), F.lit("b"))),
    ).first()
    assert tuple(got) == (0.25, None, None, None, None, "0.5", "3", "a\nb c", "Oxyrhynchite", "b;a")
