import json
import logging
import shutil
from dataclasses import asdict, replace

import pytest
from pyspark.sql import functions as F

from textlineage import cli
from textlineage.config import Settings
from textlineage.functions.scalar import missing_to_null, parse_year
from textlineage.functions.tokenize import STRATEGIES, drop_words, tokenizer
from textlineage.operators import pairs
from textlineage.plans.runner import run_all
from textlineage.sources import artifacts, sniff
from textlineage.sources.documents import formats, list_files, read_documents, scan_csv
from textlineage.sources.stopwords import BUILT_IN, read_stopwords

HEADER = "申请号,申请年份,专利类型,专利名称,摘要文本,主权项内容,申请日,申请人,申请人类型,申请人地址,申请人城市"


def write(folder, name, rows, encoding="utf-8", header=HEADER):
    (folder / name).write_bytes("\n".join([header, *rows, ""]).encode(encoding))


@pytest.fixture
def corpus(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    write(d, "a.csv", ['1,2010,发明授权,甲,"多行\n文本",丙,2010-01-01,x,y,z,w', "2,bad,发明授权,乙,NA,,2011/02/03,,,,", "3,2012,实用新型,乙,,,,,,,", "2,2013,发明授权,later,,,,,,,", "4,,发明授权,无,,,nonsense,,,,", ",2014,发明授权,空,,,,,,,"])
    write(d, "B.CSV", ["1,2015,发明授权,dup,,,,,,,", "5,２０１６,发明授权,国标,电池,材料,20160101,x,y,z,w", "6,,发明授权,日期,,,20170405,,,,"], "gb18030")
    write(d / "sub", "c.csv", ["7,2010,发明授权,no,,,,,,,"])
    return d


def test_documents(spark, corpus):
    s = Settings(data_path=str(corpus))
    got = {r.id: r for r in read_documents(spark, s).collect()}
    assert {k: v.yr for k, v in got.items()} == {"1": got["1"].yr, "2": 2011, "nan": 2014, "5": 2016, "6": 2017}
    # Files in path order: B.CSV comes before a.csv.
    assert (got["1"].yr, got["1"].title) == (2015, "dup") and got["2"].text == "乙" and got["5"].text == "国标电池材料" and got["5"].申请人城市 == "w" and got["2"].申请人 == ""
    assert len(list_files(spark, str(corpus)).collect()) == 2 and list_files(spark, str(corpus / "a.csv")).first().path.endswith("a.csv")
    with pytest.raises(RuntimeError, match="no column"):
        read_documents(spark, Settings(data_path=str(corpus), extra_cols=("absent",)))


def test_names_and_records_of_any_form(spark, tmp_path):
    """Names with spaces and signs, records over several lines in some files only, names that stand twice in a header."""
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    (tmp_path / "x y").mkdir()
    write(tmp_path / "x y", "a b.csv", ["1,2010,发明授权,国标,,,,,,,"], "gb18030")
    write(tmp_path / "x y", "a%20b+c.csv", ["2,2011,发明授权,甲,,,,,,,"])
    write(tmp_path / "x y", "两行.csv", ['3,2012,发明授权,乙,"一\n二",,,,,,'])
    write(tmp_path / "x y", "twice.csv", ["4,2013,发明授权,丙,,,,,,,,again"], header=HEADER + ",专利名称")
    groups = formats(spark, [r.path for r in list_files(spark, str(tmp_path / "x y")).collect()])
    assert {k: len(v) for k, v in groups.items()} == {("gb18030", False): 1, ("utf-8", False): 2, ("utf-8", True): 1}
    got = {r.id: r for r in read_documents(spark, Settings(data_path=str(tmp_path / "x y"))).collect()}
    assert {k: v.title for k, v in got.items()} == {"1": "国标", "2": "甲", "3": "乙", "4": "丙"} and got["3"].text == "乙一\n二"
    read_stopwords(spark, [str(tmp_path / "x y")])
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before  # the caller's session stays as it is


CELLS = ["plain", "", '""', '"quoted"', '"a, b"', '"two\nlines"', '"with ""quotes"" in"', '"""\n"""', '5" disk', '"x"y', '"open ""\n\n"" close"', '"\n,\n"']


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_records_over_lines_are_found_in_splits(spark, tmp_path, ends):
    """Quoted fields over lines, doubled and stray quotes, in pieces of a few hundred bytes: as the reader of whole files has them."""
    import random

    from textlineage.sources import records

    rng = random.Random(3)
    rows = [",".join([str(i), *[rng.choice(CELLS).replace("\n", ends) for _ in range(3)]]) for i in range(900)]
    rows.insert(400, '9999,"' + ("long " * 300 + ends) * 6 + '",x,y')  # goes on over whole splits
    path = tmp_path / "a.csv"
    path.write_bytes(ends.join(["k,a,b,c", *rows, ""]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        found = scan_csv(spark, str(path), ["k", "a", "b", "c"]).select("k", "a", "b", "c", "_line")
        assert records.lines_of(spark, [str(path)]).rdd.getNumPartitions() > 40
        got = [tuple(r)[:4] for r in sorted(found.collect(), key=lambda r: r._line)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    want = [tuple(r) for r in whole.select(*[missing_to_null(F.col(c)).alias(c) for c in ("k", "a", "b", "c")]).collect()]
    assert len(got) == len(want) == 901 and got == want


def test_ids_are_made_unique_on_keys(spark, corpus):
    """No text is in an aggregate, nor, while few rows go, in a shuffle."""
    plan = read_documents(spark, Settings(data_path=str(corpus)))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("text" in line for line in plan.splitlines() if "Aggregate" in line) and "LeftAnti" in plan and "broadcast" in plan


SEGMENTER = """
WORDS = ["锂电池", "材料"]

def load_userdict(path):
    WORDS.extend(open(path, encoding="utf-8").read().split())

def cut(text, HMM=True):
    i = 0
    while i < len(text):
        w = next((w for w in sorted(WORDS, key=len, reverse=True) if text.startswith(w, i)), text[i])
        yield w
        i += len(w)
"""


def test_segmenting_by_dictionary(spark, tmp_path, monkeypatch):
    """With a package of the same calls in the place of the optional one."""
    (tmp_path / "jieba.py").write_text(SEGMENTER, "utf-8")
    spark.sparkContext.addPyFile(str(tmp_path / "jieba.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "words.txt").write_text("负极\n", "utf-8")
    df = spark.createDataFrame([("锂电池 abc材料的，负极材料",), (None,)], "t string")
    cut = lambda *a: df.select(tokenizer(*a)(F.col("t")).alias("x")).first().x
    assert cut("auto") == cut("jieba", str(tmp_path / "absent.txt")) == ["锂电池", "材料", "的", "负", "极", "材料"]
    assert cut("jieba", str(tmp_path / "words.txt")) == ["锂电池", "材料", "的", "负极", "材料"]


def test_years(spark):
    rows = [("2010", None), ("2010-05", None), (" 201", "1999-01-01"), ("x", "2001/02/03"), (None, "20020304"), (None, "2003-04-05 10:00:00"), (None, "zz"), (None, None)]
    got = [r.y for r in spark.createDataFrame(rows, "a string, b string").select(parse_year(F.col("a"), F.col("b")).alias("y")).collect()]
    assert got == [2010, 2010, 201, 2001, 2002, 2003, None, None]


def test_tokenizers(spark):
    df = spark.createDataFrame([("锂电池 abc 材料A的",)], "t string")
    one = lambda f: df.select(f(F.col("t")).alias("x")).first().x
    assert one(STRATEGIES["cjk_runs"]) == ["锂电池", "材料", "的"]
    assert one(STRATEGIES["cjk_bigram"]) == ["锂电", "电池", "材料", "的"]
    assert one(STRATEGIES["regex"]) == ["abc", "a"]
    assert one(lambda c: drop_words(F.array(*map(F.lit, "abab")), F.array(F.lit("b")))) == ["a", "a"]


def test_stopwords(spark, tmp_path):
    (tmp_path / "w" / "x").mkdir(parents=True)
    (tmp_path / "w" / "a.txt").write_text(" 新词 \n\n方法\n", "utf-8")
    (tmp_path / "w" / "x" / "b.TXT").write_bytes("国标\n".encode("gb18030"))
    (tmp_path / "w" / "c.md").write_text("不")
    got = {r.term for r in read_stopwords(spark, [str(tmp_path / "w"), str(tmp_path / "absent")]).collect()}
    assert got == {*BUILT_IN, "新词", "国标"} and len(BUILT_IN) == 35


def test_sniffing(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("名;数\n甲;1\n乙;2\n".encode("gb18030"))
    assert sniff.sniff(spark, str(p))["delimiter"] == ";" and sniff.detect_encoding(p.read_bytes()) == "gb18030"
    assert sniff.detect_encoding(b"\xef\xbb\xbfa") == "utf-8-sig" and sniff.detect_encoding("é".encode()[:1] + b"") == "utf-8"
    assert sniff.detect_delimiter("a b\nc") == ","
    r = sniff.line_report(spark, str(p)).first()
    assert r.physical_lines == 3 and r.data_rows_estimate in (2, 3)


def test_exchange_formats(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"size": 2, "vocab": {"a": 0, "b": 1}}))
    (tmp_path / "bare.json").write_text(json.dumps({"a": 0, "b": 1}))
    for name in ("v.json", "bare.json"):
        assert {tuple(r) for r in artifacts.read_vocab_json(spark, str(tmp_path / name)).collect()} == {("a", 0), ("b", 1)}
    v = spark.createDataFrame([("a", 0), ("b", 1)], "term string, term_id int")
    artifacts.write_vocab_json(v, str(tmp_path / "lines"))
    assert sorted(map(tuple, artifacts.read_vocab_json(spark, str(tmp_path / "lines")).collect())) == [("a", 0), ("b", 1)]
    (tmp_path / "term_df_year=2010.json").write_text(json.dumps({"df": {"a": 3}, "docs": 4}))
    assert tuple(artifacts.read_term_df_json(spark, str(tmp_path / "term_df_year=2010.json")).first()) == (2010, 4, "a", 3)
    t = spark.createDataFrame([("1", "t", ["x", "x"], 2010)], "id string, title string, tokens array<string>, yr int")
    artifacts.write_token_lines(t, str(tmp_path / "tok"))
    assert artifacts.read_token_lines(spark, str(tmp_path / "tok")).first().tokens == ["x", "x"]


@pytest.fixture
def job(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write(d, "a.csv", [f"{i},{2010 + i % 4},发明授权,锂电池{'材料' * (i % 3)},隔膜{'改性' if i % 2 else '算法'},,,a,b,c,d" for i in range(24)])
    (tmp_path / "prune.txt").write_text("材料\n", "utf-8")
    return Settings(data_path=str(d), tokenizer="cjk_bigram", min_term_count=1, max_doc_freq_ratio=0.9, df_ratio_threshold=0.95, artifacts_dir=str(tmp_path / "out"), final_csv=str(tmp_path / "final"), export_json=True, export_csv=True, log_file=str(tmp_path / "run.log"))


def test_runner_resumes_by_settings(spark, tmp_path, job):
    s = job
    first = sorted(map(tuple, run_all(spark, s).collect()))
    assert len(first) == 24 and any(float(r[3]) > 0 for r in first)
    stamps = lambda: {str(p.relative_to(tmp_path / "out")): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    stamp = stamps()
    assert sorted(map(tuple, run_all(spark, s).collect())) == first
    assert stamps() == stamp  # nothing ran
    again = run_all(spark, replace(s, similarity_threshold=0.9999999))
    assert again.count() == 24
    now = stamps()
    assert {k for k in stamp if k.startswith("vectors/")} <= set(now) and not any(k in now for k in stamp if k.startswith("bsfs/"))
    assert spark.read.option("header", True).csv(str(tmp_path / "final")).count() == 24
    by_year = spark.read.option("header", True).csv(str(tmp_path / "out" / "bsfs_csv"))
    assert by_year.columns == ["id", "BS", "FS", "yr"] and by_year.count() == 24
    exported = tmp_path / "out" / "json"
    assert {p.name for p in exported.iterdir()} == {"term_df", "global_df", "docs_per_year", "docs_per_year_csv", "pair_list", "vocab"}
    assert sorted((r.yr_x, r.yr_y) for r in spark.read.json(str(exported / "pair_list")).collect()) == [(a, b) for a in range(2010, 2014) for b in range(a + 1, 2014)]
    assert spark.read.option("header", True).csv(str(exported / "docs_per_year_csv")).columns == ["year", "count"]
    assert sorted(map(tuple, artifacts.read_vocab_json(spark, str(exported / "vocab")).collect())) == sorted(map(tuple, spark.read.parquet(f"{s.artifacts_dir}/vocab").select("term", "term_id").collect()))


STAGES = ["tokens", "docs_per_year", "term_df", "vocab", "vectors", "vectors_filtered", "postings", "pairs", "pair_meta", "bsfs", "final"]


def test_runner_repeats_what_is_lost_alone(spark, tmp_path, job):
    """Each stage goes, whole and by one year, then a setting changes as well: the result is the first run's, and what was sound stays as it was."""
    job = replace(job, export_json=False, final_csv="")
    first = sorted(map(tuple, run_all(spark, job).collect()))
    out = tmp_path / "out"
    files = lambda: {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    for i in range(3):
        for name in STAGES[i::3]:
            shutil.rmtree(out / name)
        stamp = files()
        assert sorted(map(tuple, run_all(spark, job).collect())) == first, i
        assert stamp.items() <= files().items() and all((out / name).is_dir() for name in STAGES), i
    lost = [next(iter(sorted((out / name).glob("yr*=2011")))) for name in STAGES if list((out / name).glob("yr*=2011"))]
    assert len(lost) == 7
    for folder in lost:
        shutil.rmtree(folder)
    stamp = files()
    other = replace(job, epsilon=1e-7)
    assert [r[:5] for r in sorted(map(tuple, run_all(spark, other).collect()))] == [r[:5] for r in first]  # all but the ratio
    now = files()
    assert all(f.is_dir() for f in lost) and {p: t for p, t in stamp.items() if p.parts[-2] != "final"}.items() <= now.items()
    base = spark.read.parquet(str(out / "vectors_filtered"))
    assert sorted(map(tuple, pairs.entries(artifacts.read_table(spark, str(out / "postings"), 2011)).collect())) == sorted(map(tuple, base.filter("yr = 2011").select("id", "yr", "term_id", "w").collect()))
    meta = spark.read.parquet(str(out / "pair_meta")).collect()
    assert {(r.yr_x, r.yr_y) for r in meta} == {(a, b) for a in range(2010, 2014) for b in range(a + 1, 2014)} and all((r.thr, r.window_size, r.method_version, r.vectors_dir) == (0.05, 5, "v1", "vectors_filtered") for r in meta)


def test_runner_finds_damage(spark, tmp_path, job):
    """A file of a year is lost or cut short, a folder that was never committed is there, a manifest was half written: all as in the first run."""
    job = replace(job, export_json=False, final_csv="")
    first = sorted(map(tuple, run_all(spark, job).collect()))
    out = tmp_path / "out"
    one = lambda folder: next(p for p in (out / folder).rglob("*.parquet"))
    one("vectors/yr=2012").unlink()
    cut = one("bsfs/yr=2013")
    cut.write_bytes(cut.read_bytes()[:40])
    one("vocab").unlink()
    shutil.copytree(out / "pairs" / "yr_x=2011", out / "pairs" / "yr_x=2099")
    assert sorted(map(tuple, run_all(spark, job).collect())) == first
    assert not (out / "pairs" / "yr_x=2099").exists()
    versions = sorted((out / "manifest").glob("*.json"))
    assert len(versions) == 2
    (out / "manifest" / f"{int(versions[-1].stem) + 1:08d}.json").write_text('{"tokens": {"key"')  # cut short
    stamp = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    assert sorted(map(tuple, run_all(spark, job).collect())) == first
    assert stamp == {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}


def test_runner_goes_on_after_a_crash(spark, tmp_path, job, monkeypatch):
    from textlineage.plans import stages

    job = replace(job, export_json=False, final_csv="", years_per_write=2)
    write_table, wrote, crashed = artifacts.write_table, [], []

    def failing(df, path, by):
        wrote.append(path.rpartition("/")[2])
        write_table(df, path, by)
        if wrote.count("vectors") == 2 and not crashed:
            crashed.append(path)
            raise InterruptedError  # written, not yet marked

    monkeypatch.setattr(stages.artifacts, "write_table", failing)
    with pytest.raises(InterruptedError):
        run_all(spark, job)
    wrote.clear()
    rows = sorted(map(tuple, run_all(spark, replace(job, years_per_write=1)).collect()))
    assert wrote.count("vectors") == 2 and not {"tokens", "term_df", "vocab"} & set(wrote)  # two years were marked, two are written again
    monkeypatch.undo()
    assert rows == sorted(map(tuple, run_all(spark, replace(job, artifacts_dir=str(tmp_path / "other"))).collect()))


def test_runner_sees_that_the_input_changed(spark, tmp_path, job):
    """A lost year comes back with other rows, so what depends on it is made anew."""
    job = replace(job, export_json=False, final_csv="")
    run_all(spark, job)
    write(tmp_path / "in", "b.csv", [f"n{i},2013,发明授权,锂电池材料,隔膜,,,a,b,c,d" for i in range(3)])
    shutil.rmtree(tmp_path / "out" / "tokens" / "yr=2013")
    got = sorted(map(tuple, run_all(spark, job).collect()))
    assert len(got) == 27 and got == sorted(map(tuple, run_all(spark, replace(job, artifacts_dir=str(tmp_path / "other"))).collect()))


def test_a_year_is_added(spark, tmp_path, job):
    """A file with a later year, of known words: earlier vectors stay, as do pairs and scores out of its window; all is as in a full run. Then one with
    new words, which gives terms other ids, and one year less."""
    job = replace(job, export_json=False, final_csv="", window_size=2)
    run_all(spark, job)
    out = tmp_path / "out"
    stamps = lambda: {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    full = lambda name: sorted(map(tuple, run_all(spark, replace(job, artifacts_dir=str(tmp_path / name))).collect()))
    before = stamps()
    write(tmp_path / "in", "b.csv", [f"n{i},2014,发明授权,锂电池{'材料' * (i % 3)},隔膜{'改性' if i % 2 else '算法'},,,a,b,c,d" for i in range(6)])
    got = sorted(map(tuple, run_all(spark, job).collect()))
    assert len(got) == 30 and got == full("full")
    kept = {str(p.parent.relative_to(out)) for p, t in before.items() if stamps().get(p) == t}
    years = lambda name: {int(k[-4:]) for k in kept if k.startswith(name + "/")}
    assert years("tokens") == years("term_df") == years("vectors") == {2010, 2011, 2012, 2013} and years("vectors_filtered") == years("postings") == {2011, 2012, 2013}
    assert 2011 in years("pairs") and not {2012, 2013} & years("pairs") and years("bsfs") == {2010, 2011}
    write(tmp_path / "in", "c.csv", [f"m{i},2014,发明授权,不同词语,一些,,,a,b,c,d" for i in range(4)])
    assert sorted(map(tuple, run_all(spark, job).collect())) == full("full2")
    for name in ("b.csv", "c.csv"):
        (tmp_path / "in" / name).unlink()
    assert len(run_all(spark, job).collect()) == 24 and not (out / "vectors" / "yr=2014").exists()


def test_runner_survives_stages_without_rows(spark, tmp_path):
    """Five documents, one a year: every term is in a fifth of its year at least, so pruning leaves nothing, and all scores are 0. A file of a header alone gives nothing."""
    d = tmp_path / "five"
    d.mkdir()
    write(d, "a.csv", [f"CN{i},{2010 + i},发明授权,锂电池{w},{w}结构,,2010-06-01,a,b,c,d" for i, w in enumerate(["电极", "隔膜", "算法", "冷却", "接口"])])
    s = Settings(data_path=str(d), tokenizer="cjk_bigram", min_term_count=1, max_doc_freq_ratio=0.9, window_size=2, artifacts_dir=str(tmp_path / "out"), export_json=True, export_csv=True, final_csv=str(tmp_path / "final"))
    rows = run_all(spark, s).collect()
    assert len(rows) == 5 and {r[3:6] for r in map(tuple, rows)} == {("0.00000000",) * 3}
    assert spark.read.option("header", True).csv(str(tmp_path / "final")).count() == 5 and spark.read.option("header", True).csv(str(tmp_path / "out" / "bsfs_csv")).count() == 5
    assert sorted(map(tuple, run_all(spark, s).collect())) == sorted(map(tuple, rows))
    empty = tmp_path / "none"
    empty.mkdir()
    write(empty, "a.csv", [])
    none = run_all(spark, replace(s, data_path=str(empty), artifacts_dir=str(tmp_path / "nothing")))
    assert none.count() == 0 and none.columns[:3] == ["申请号", "申请年份", "专利名称"]


def test_pruning_has_a_list_of_its_own(spark, tmp_path, job):
    run_all(spark, job).count()
    words = spark.read.parquet(f"{job.artifacts_dir}/vocab")
    listed = words.filter("term = '材料'").first().term_id
    kept = lambda: spark.read.parquet(f"{job.artifacts_dir}/vectors_filtered").filter(F.col("term_id") == listed).count()
    assert kept() > 0
    run_all(spark, replace(job, prune_word_paths=(str(tmp_path / "prune.txt"),))).count()
    assert kept() == 0 and spark.read.parquet(f"{job.artifacts_dir}/vectors").filter(F.col("term_id") == listed).count() > 0


def test_stages_show_where_time_goes(spark, tmp_path):
    """Rows, shuffle and skew of each stage of a job with a key that holds nearly all rows; nothing of the jobs before."""
    from textlineage.plans.metrics import StageWatch

    spark.range(1_000).groupBy("id").count().collect()
    with StageWatch(spark) as watch:
        rows = spark.range(0, 400_000, 1, 4).select(F.when(F.col("id") % 100 > 0, 7).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        rows.repartition(8, "k").write.parquet(str(tmp_path / "out"))
    table = {r.stage: r for r in watch.table().collect()}
    assert len(table) == 2 and sorted(r.tasks for r in table.values())[0] == 4
    first, last = (table[k] for k in sorted(table))
    assert first.rows_out == last.rows_in == last.rows_out == 400_000 and first.shuffle_written_mb > 1 and last.shuffle_read_mb == pytest.approx(first.shuffle_written_mb)
    assert last.most_rows >= 396_000 and last.skew > 7 and first.skew < 1.5 and last.longest_s >= last.median_s and "skew" in watch.text().splitlines()[0]


def test_command_line(spark, tmp_path, job, capsys, monkeypatch):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps(asdict(job)), "utf-8")
    (tmp_path / "run.log").write_text("earlier run", "utf-8")
    root = logging.getLogger()
    monkeypatch.setattr(root, "handlers", root.handlers[:])
    for command in (["run"], ["year", "--year", "2011"], ["profile", "--year", "2011", "--out", str(tmp_path / "p")], ["stats", "--k", "2"]):
        assert cli.main([command[0], str(path), *command[1:]]) == 0
        if command[0] == "run":
            text = (tmp_path / "run.log").read_text("utf-8")
            assert "stage vectors: " in text and "rows" in text and "earlier run" not in text
    said = capsys.readouterr().out
    assert "Physical Plan" in said and "shuffle_read_mb" in said and all(t in said for t in ("average vocabulary use", "DF pair sums of the top terms", "row length histogram"))
    assert spark.read.option("header", True).csv(f"{job.artifacts_dir}/year=2011").count() == 6
    assert cli.main(["sniff", str(tmp_path / "in" / "a.csv")]) == 0
