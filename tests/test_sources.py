from __future__ import annotations

import json
import zipfile
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from lakeprofile.plans import analysis
from lakeprofile.sources import delimited, encodings, load, sink, workbook


def write(tmp_path, name: str, text: str, encoding: str = "utf-8") -> str:
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def read(spark, path, **options) -> pd.DataFrame:
    return load.load_table(spark, path, **options).toPandas()


def test_plain_file(spark, tmp_path):
    df = load.load_table(spark, write(tmp_path, "a.csv", "a,b,c\n1,2.5,x\n2,3.5,y\n"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert df.count() == 2


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_sniffed_delimiter(spark, tmp_path, delimiter):
    text = "a,b,c\n1,2,3\n4,5,6\n".replace(",", delimiter)
    assert list(read(spark, write(tmp_path, "d.txt", text)).columns) == ["a", "b", "c"]


def test_names_are_stripped_and_kept_apart(spark, tmp_path):
    path = write(tmp_path, "n.csv", " col1 , col2 ,col1,\n1,2,3,4\n")
    assert list(read(spark, path).columns) == ["col1", "col2", "col1.1", "Unnamed: 3"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    path = write(tmp_path, "e.csv", "name €,n\nMüller “x”,1\nÉtoile,2\n", encoding)
    got = read(spark, path)
    assert list(got.columns) == ["name €", "n"]
    assert list(got["name €"]) == ["Müller “x”", "Étoile"]


WRITTEN = {
    "cp1250": "miasto,kraj\nŁódź,Polska\nWrocław,śląskie\nČeské Budějovice,Česko\n“Plzeň”,Česko\n",
    "iso8859-2": "miasto,kraj\nŁódź,śląskie\nWrocław,Polska\nŠumava,žluťoučký kůň\n",
    "cp1251": "город,страна\nМосква,Россия\nСАНКТ-ПЕТЕРБУРГ,Россия\n№ 1,Новосибирск\n",
    "koi8-r": "город,страна\nМосква,Россия\nСанкт-Петербург,Россия\n",
    "iso8859-15": "nom,prix\nœuvre,12 €\ncafé,3 €\nÉtoile,5 €\n",
    "cp1253": "πόλη,χώρα\nΑθήνα,Ελλάδα\nΘεσσαλονίκη,Ελλάδα\n",
    "cp1254": "şehir,ülke\nİstanbul,Türkiye\nDiyarbakır,Türkiye\nEskişehir,Türkiye\nMuğla,Türkiye\n",
    "cp932": "都市,国\n東京,日本\nさっぽろ,ほっかいどう\nコーヒー,表示ソフト\n",
    "euc_jp": "都市,国\n東京,日本\nさっぽろ,ほっかいどう\nコーヒー,飲み物\n",
    "gb18030": "城市,国家\n北京,中国\n上海,中国\n广州,中国\n𠀀,中国\n",
    "big5": "城市,國家\n臺北,臺灣\n高雄,臺灣\n新竹,臺灣\n",
    "cp949": "도시,나라\n서울,대한민국\n부산,대한민국\n인천,대한민국\n",
}


@pytest.mark.parametrize("encoding", WRITTEN)
def test_encodings_are_told_apart(spark, tmp_path, encoding):
    head, *lines = [tuple(line.split(",")) for line in WRITTEN[encoding].splitlines()]
    path = write(tmp_path, "e.csv", WRITTEN[encoding], encoding)
    got = load.load_table(spark, path)
    assert tuple(got.columns) == head and [tuple(r) for r in got.collect()] == lines
    assert delimited.sniff(spark, path).first()["encoding"] == encoding


def test_encodings_of_many_files_at_once(spark, tmp_path):
    chosen = ["cp1250", "cp1251", "cp949"]
    for encoding in chosen:
        lines = WRITTEN[encoding].splitlines()
        write(tmp_path, f"{encoding}.csv", "\n".join(["a,b", *lines[1:], "plain,text"]), encoding)
    got = {tuple(r) for r in load.load_table(spark, str(tmp_path), "csv").collect()}
    assert got >= {tuple(x.split(",")) for e in chosen for x in WRITTEN[e].splitlines()[1:]}


def test_undecided_encodings_raise(spark, tmp_path):
    path = write(tmp_path, "u.csv", "a,b\nGyőr,Magyarország\nKőszeg,Szűcs\n", "cp1250")
    with pytest.raises(ValueError, match="name the encoding"):
        load.load_table(spark, path)
    named = delimited.read_delimited(spark, path, encoding="windows-1250")
    assert named.first()["a"] == "Győr"
    bars = write(tmp_path, "bars.csv", WRITTEN["cp932"].replace(",", "|"), "cp932")
    with pytest.raises(ValueError, match="convert"):
        load.load_table(spark, bars)


def test_scores_do_not_depend_on_how_lines_are_dealt(spark):
    lines = [("p", x.encode("cp1251")) for x in WRITTEN["cp1251"].splitlines()] * 50
    df = spark.createDataFrame(lines, "path string, value binary")
    found = [
        {r["encoding"]: round(r["score"], 3) for r in encodings.encoding_scores(df.repartition(n)).collect()}
        for n in (1, 5)
    ]
    assert found[0] == found[1] and max(found[0], key=found[0].get) == "cp1251"


def test_files_are_looked_at_as_a_whole(spark, tmp_path):
    """What only shows far into a file counts: a letter, a delimiter, a quoted line break."""
    for k, d in enumerate(",;|"):
        write(tmp_path, f"f{k}.csv", f"a{d}b\n" + f"1{d}2\n" * 9)
    write(tmp_path, "late.csv", "a,b\n" + "plain;,1\n" * 20_000 + "caf\xe9,2\n", "cp1252")
    write(tmp_path, "quote.csv", "a,b\n" + "x,1\n" * 20_000 + '"two\nlines",2\n')
    got = {r["path"].rsplit("/", 1)[-1]: r for r in rows(delimited.sniff(spark, str(tmp_path)))}
    assert [got[f"f{k}.csv"]["delimiter"] for k in range(3)] == [",", ";", "|"]
    assert got["late.csv"]["encoding"] == "cp1252" and got["f0.csv"]["encoding"] == "utf-8"
    assert got["quote.csv"]["open_quotes"] == 2
    late = load.load_table(spark, str(tmp_path / "late.csv"))
    assert late.where("b = 2").first()["a"] == "café" and late.count() == 20_001
    assert load.load_table(spark, str(tmp_path / "quote.csv")).where("b = 2").first()["a"] == "two\nlines"


def test_folders_patterns_and_compression(spark, tmp_path):
    import gzip

    folder = tmp_path / "parts.csv"
    folder.mkdir()
    write(folder, "a.csv", "k,v\n1,x\n2,ä\n")
    write(folder, "b.csv", "k,v\n3,ü\n", "cp1252")
    (folder / "c.csv.gz").write_bytes(gzip.compress(b"k,v\n4,z\n"))
    want = [(1, "x"), (2, "ä"), (3, "ü"), (4, "z")]
    for path in (folder, folder / "*.csv*"):
        assert sorted(map(tuple, load.load_table(spark, str(path)).collect())) == want
    assert load.load_table(spark, str(folder / "c.csv.gz")).count() == 1
    write(folder, "d.csv", "k;v\n5;w\n")
    with pytest.raises(ValueError, match="differ in delimiter"):
        load.load_table(spark, str(folder))


def test_records_with_too_many_cells(spark, tmp_path):
    path = write(tmp_path, "r.csv", 'a,b\n1,2\n3,4,5\n6\n"7,8",9\n')
    with pytest.raises(ValueError, match="more than 2 cells"):
        load.load_table(spark, path)
    assert [r["record"] for r in rows(delimited.bad_records(spark, path))] == ["3,4,5"]
    short = load.load_table(spark, write(tmp_path, "s.csv", 'a,b\n1,2\n6\n"7,8",9\n'))
    assert sorted(map(tuple, short.collect())) == [("1", 2.0), ("6", None), ("7,8", 9.0)]


def test_large_whole_numbers_stay_exact(spark, tmp_path):
    text = "long,gap,huge,longer,mixed\n" + "".join(
        f"900719925474099300{k},{'' if k == 3 else 900719925474099300 + k},{k}{'9' * 29},{'8' * 45},{k}.5\n"
        for k in range(1, 5)
    )
    df = load.load_table(spark, write(tmp_path, "w.csv", text))
    assert dict(df.dtypes) == {
        "long": "bigint", "gap": "bigint", "huge": "decimal(38,0)", "longer": "string", "mixed": "double",
    }
    assert df.select("long").distinct().count() == 4


def test_names(spark):
    assert delimited.clean_names([" a", "a", "", "a.1", None]) == ["a", "a.1", "Unnamed: 2", "a.1.1", "None"]


def test_cell_types(spark, tmp_path):
    text = (
        "whole,gap,flag,gapflag,blank,sci,day,mixed\n"
        "1,1,True,True,,1e3,2024-01-05,1\n-2,NA,False,,, 2 ,01/06/2024,x\n"
    )
    path = write(tmp_path, "t.csv", text)
    df = load.load_table(spark, path, parse_dates=["day", "mixed"])
    assert dict(df.dtypes) == {
        "whole": "bigint", "gap": "double", "flag": "boolean", "gapflag": "string",
        "blank": "double", "sci": "double", "day": "timestamp", "mixed": "string",
    }
    second = df.collect()[1]
    assert second["day"] == datetime(2024, 1, 6) and second["gap"] is None


def test_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'a,b\n"x, y","say ""hi"""\n"two\nlines",z\n')
    got = read(spark, path)
    assert list(got["a"]) == ["x, y", "two\nlines"] and got["b"][0] == 'say "hi"'


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="no reader"):
        load.load_table(spark, "data.xyz")


def test_parquet_is_read(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    pd.DataFrame({"a": [1, 2]}).to_parquet(path)
    assert read(spark, path)["a"].tolist() == [1, 2]


def build_workbook(path) -> str:
    """A workbook with two sheets, shared and inline strings, a date and an error cell."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets>'
        '<sheet name="First" sheetId="1" r:id="rId1"/><sheet name="Second" sheetId="2" r:id="rId2"/>'
        "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/'
        'package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
        '<Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>a</t></si><si><t> b </t></si>"
        "<si><r><t>x</t></r><r><t>!</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
        "</cellXfs></styleSheet>",
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1">'
        '<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is>'
        '<t>day</t></is></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c>'
        '<c r="C2" s="1"><v>45296</v></c></row><row r="3"><c r="A3"><v>2</v></c>'
        '<c r="B3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" '
        't="inlineStr"><is><t>z</t></is></c></row><row r="2"><c r="A2"><v>2.5</v></c></row>'
        "</sheetData></worksheet>",
    }
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return str(path)


def test_workbook(spark, tmp_path):
    path = build_workbook(tmp_path / "w.xlsx")
    df = load.load_table(spark, path, parse_dates=["day"])
    assert df.columns == ["a", "b", "day"] and dict(df.dtypes)["day"] == "timestamp"
    got = sorted(df.collect())
    assert [r["a"] for r in got] == [1, 2] and [r["b"] for r in got] == ["x!", None]
    assert got[0]["day"] == datetime(2024, 1, 5)
    assert load.load_table(spark, path, sheet="Second").collect()[0]["z"] == 2.5
    assert load.load_table(spark, path, sheet=1).columns == ["z"]
    listed = [(r["sheet_index"], r["sheet_name"]) for r in rows(workbook.list_sheets(spark, path))]
    assert listed == [(0, "First"), (1, "Second")]


def test_preparation(spark, beds, frame):
    df = frame(beds)
    assert load.drop_columns(df, ["height", "nothing"]).columns == ["weight", "shade", "soil", "fenced"]
    first = load.sample_rows(df, 50)
    assert first.columns == df.columns and first.count() == 50
    assert first.distinct().join(df, df.columns, "left_semi").count() == 50
    assert sorted(first.collect()) == sorted(first.collect())
    assert load.sample_rows(df, 500).count() == 240 and load.sample_rows(df, 0) is df


def test_sample_does_not_depend_on_the_layout(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 7 as string) as s", "nullif(id % 3, 0) as n")
    first = sorted(map(tuple, load.sample_rows(df, 120).collect()))
    assert first == sorted(map(tuple, load.sample_rows(df.repartition(11, "s"), 120).collect()))
    assert len(first) == 120 and first != sorted(map(tuple, load.sample_rows(df, 120, seed=7).collect()))
    many = spark.range(900).selectExpr("id % 4 as x").unionAll(spark.range(50).selectExpr("id + 10"))
    got = load.sample_rows(many, 300)
    assert got.count() == 300
    assert sorted(got.collect()) == sorted(load.sample_rows(many.repartition(5), 300).collect())


def test_sample_of_copies_is_not_one_copy(spark):
    """A third of the rows are one row, and so is about a third of the sample."""
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id end as x")
    got = load.sample_rows(df, 600).where("x = 0").count()
    assert 140 < got < 260


def test_json_sections(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", float("nan"), [1.0, float("inf")])], "k string, x double, l array<double>"
    )
    sink.write_sections({"part": df}, str(tmp_path))
    lines = [f.read_text() for f in (tmp_path / "part").glob("*.json")]
    assert json.loads("".join(lines)) == {"k": "a", "x": None, "l": [1.0, None]}


def test_analysis_sections(spark, frame, beds):
    sections = analysis.analyze(frame(beds), target="fenced")
    assert set(sections) >= {"quality", "outlier", "correlation_spearman", "target"}
    short = analysis.analyze(frame(beds), skip_correlation=True, skip_outlier=True)
    assert not [s for s in short if s.startswith(("correlation", "outlier", "target"))]


def test_batch_isolates_failures(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(0)
    pd.DataFrame({"x": rng.normal(size=60), "k": ["a", "b"] * 30}).to_csv(
        folder / "good.csv", index=False
    )
    (folder / "broken.xlsx").write_bytes(b"no workbook")
    (folder / "empty.csv").write_text("a,b\n")
    (folder / "skipped.doc").write_text("")
    out = tmp_path / "out"
    sections, status = analysis.batch(spark, str(folder), str(out), skip_correlation=True)
    found = {r["dataset"]: r["status"] for r in rows(status)}
    assert found == {"good.csv": "ok", "broken.xlsx": "failed", "empty.csv": "failed"}
    assert {r["dataset"] for r in rows(sections["overview"])} == {"good.csv"}
    assert (out / "distribution_numeric").is_dir() and (out / "status").is_dir()
    with pytest.raises(NotADirectoryError):
        analysis.batch(spark, str(tmp_path / "nowhere"))
