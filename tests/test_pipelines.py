import pytest

from sitometra import __main__ as command
from sitometra.config import HarvestOptions, LinkOptions, SampleOptions
from sitometra.plans import pipelines
from sitometra.sources import tables
from sitometra.streaming import linking

DOC = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>Account</title></titleStmt><idno type="ddb-hybrid">d;{0}</idno>
<origPlace>Theben</origPlace><origDate when="0134-05-29">134</origDate></teiHeader>
<div type="edition"><!-- note --><ab>τιμὴ πυροῦ ἀρταβῶν <num value="{1}">x</num><!-- note --> δραχμαὶ <num value="300">τ</num></ab></div></TEI>"""


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    for i in range(12):
        (top / f"sub{i % 2}").mkdir(exist_ok=True)
        (top / f"sub{i % 2}" / f"{i}.xml").write_text(DOC.format(i, 10 + i), encoding="utf-8")
    (top / "bad.xml").write_text("<TEI>")
    return top


def test_stages_from_files_to_files(spark, corpus, tmp_path):
    out = str(tmp_path / "candidates")
    found = pipelines.run_harvest(spark, str(corpus), str(corpus), out, HarvestOptions())
    assert found.count() == 12 and len(found.columns) == 20
    read = tables.read_csv(spark, out, ("DDB_ID", "XML_RelPath"))
    assert set(read.columns) == set(found.columns)
    linked = pipelines.run_link(spark, read, str(corpus), str(tmp_path / "linked"), str(tmp_path / "mentions"), LinkOptions(topk=2))
    rows = tables.read_csv(spark, str(tmp_path / "linked"))
    assert rows.count() == 24 and linked.mentions.count() == 12
    made = pipelines.run_analyze(rows, str(tmp_path / "analysis"))
    assert made["primary"].count() == 12 and made["main"].count() == 12
    assert made["trend_all"].collect()[0].n == 12 and made["review"].count() > 0
    graphs = pipelines.run_graphs(tables.read_csv(spark, str(tmp_path / "analysis/primary")), str(tmp_path / "graphs"))
    assert graphs["robust_trend"].collect()[0].n == 12 and graphs["extremes"].count() == 12
    assert pipelines.run_sample(rows, str(tmp_path / "sample"), SampleOptions(per_bin=4, max_score=100)).count() > 0
    with pytest.raises(ValueError):
        tables.read_csv(spark, out, ("Nothing",))
    with pytest.raises(ValueError):
        pipelines.run_sample(rows.where("false"))


def test_max_docs(spark, corpus):
    rows = spark.createDataFrame([(f"d;{i}", f" sub{i % 2}\\{i}.xml ") for i in range(12)] + [("", "x")], "DDB_ID string, XML_RelPath string")
    assert pipelines.run_link(spark, rows, str(corpus), options=LinkOptions(max_docs=3)).rows.count() == 3


def test_stream(spark, corpus, tmp_path):
    q = linking.start(linking.read_stream(spark, str(corpus)), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_missing_files_and_append(spark, corpus, tmp_path):
    rows = spark.createDataFrame([("d;0", "sub0/0.xml"), ("d;x", "sub0/nowhere.xml")], "DDB_ID string, XML_RelPath string")
    out = str(tmp_path / "linked")
    for times in (1, 2):
        linked = pipelines.run_link(spark, rows, str(corpus), out, mode="append")
        assert [tuple(r) for r in linked.missing.collect()] == [("d;x", "sub0/nowhere.xml")]
        assert tables.read_csv(spark, out).count() == times * linked.rows.count() > 0


def test_command_line(spark, corpus, tmp_path):
    of = lambda name: str(tmp_path / name)
    assert command.run(spark, ["harvest", str(corpus), str(corpus), of("c")]) == {"candidates": 12}
    counts = command.run(spark, ["link", of("c"), str(corpus), of("l"), of("m"), "--topk", "2"])
    assert counts == {"files": 12, "parsed": 12, "not_parsed": 0, "missing": 0, "rows": 24, "mentions": 12}
    made = command.run(spark, ["analyze", of("l"), of("a"), "--min-n", "2", "--drop-ambiguous"])
    assert made["primary"] == 12 and made["chart_scatter"] == made["main"]
    assert command.run(spark, ["graphs", of("a/primary"), of("g"), "--winsor", "0.05", "0.95", "--year-min", "9999"])["scatter"] == 0
    assert command.run(spark, ["sample", of("l"), of("s"), "--max-score", "100", "--allow-fill"])["sampled"] > 0
    with pytest.raises(FileNotFoundError):
        command.run(spark, ["sample", of("nothing"), of("s")])


def test_files_that_are_broken(spark, corpus):
    rows = spark.createDataFrame([("d;0", "sub0/0.xml"), ("d;b", "bad.xml")], "DDB_ID string, XML_RelPath string")
    counts = pipelines.run_link(spark, rows, str(corpus)).counts()
    assert (counts["files"], counts["parsed"], counts["not_parsed"], counts["missing"]) == (2, 1, 1, 0)
