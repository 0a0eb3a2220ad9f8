"""Broken drawings lose only what is broken; the data source reads the same as the parser."""

import pytest
from pyspark.errors import PythonException

from planwright.sources import dxf

HEAD, TAIL = "0\nSECTION\n2\nENTITIES\n", "0\nENDSEC\n0\nEOF\n"


def line(handle, x="1"):
    return f"0\nLINE\n5\n{handle}\n8\nL\n10\n{x}\n20\n2\n11\n30\n21\n40\n"


def handles(df):
    return sorted(r.handle for r in dxf.entities(df).collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("dxf")
    text = "0\nTEXT\n5\nT{}\n8\nL\n10\n1\n20\n2\n1\nbefore{}after\n"
    odd = "".join(text.format(k, c) for k, c in enumerate(("\x85", " ", "\x0c", "\x0b", "\x1c")))
    (d / "signs.dxf").write_bytes((HEAD + odd + line("END") + TAIL).encode())
    (d / "latin.dxf").write_bytes((HEAD + text.format("X", "\xe9\x85\xff") + line("END") + TAIL).encode("latin1"))
    (d / "crlf.DXF").write_bytes((HEAD + line("A") + line("B") + TAIL).replace("\n", "\r\n").encode())
    broken = HEAD + line("A") + line("bad", "east") + line("B") + "stray\nstray again\n" + line("C") + "0\nLINE\n5\nHALF\nnot a code\n8\nL\n" + line("D") + TAIL
    (d / "sub").mkdir()
    (d / "sub" / "broken.dxf").write_text(broken)
    (d / "empty.dxf").write_text("")
    (d / "other.txt").write_text("0\nLINE\n")
    return d


def test_only_what_is_broken_is_lost(spark, folder):
    read = lambda name, **how: dxf.read_dxf(spark, str(folder / name), **how)
    assert handles(read("signs.dxf")) == ["END", "T0", "T1", "T2", "T3", "T4"]
    assert [r.text for r in dxf.entities(read("signs.dxf")).where("handle = 'T0'").collect()] == ["before\x85after"]
    assert handles(read("latin.dxf")) == ["END", "TX"]
    assert handles(read("crlf.DXF")) == ["A", "B"]
    broken = read("sub/broken.dxf")
    assert handles(broken) == ["A", "B", "C", "D", "HALF"]
    assert sorted((r.type or "", r.corrupt) for r in dxf.corrupt(broken).collect()) == [("", "not a code"), ("", "stray"), ("LINE", "10: east")]
    assert dxf.corrupt(read("sub/broken.dxf", mode="DROPMALFORMED")).count() == 0
    with pytest.raises(PythonException):
        read("sub/broken.dxf", mode="failfast").count()
    with pytest.raises(ValueError):
        read("sub/broken.dxf", mode="loose")
    assert read("empty.dxf").count() == 0


def test_data_source_equals_the_parser(spark, folder):
    dxf.register(spark)
    whole = spark.read.format("dxf").load(str(folder))
    want = dxf.read_dxf(spark, str(folder))
    show = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert show(whole) == show(want) and whole.schema == want.schema
    assert whole.rdd.getNumPartitions() == 1
    assert spark.read.format("dxf").option("partitionBytes", 1).load(str(folder)).rdd.getNumPartitions() == 5
    assert dxf.corrupt(spark.read.format("dxf").option("mode", "dropmalformed").load(str(folder))).count() == 0
    one = spark.read.format("dxf").option("encodings", "latin1").load(str(folder / "latin.dxf"))
    assert [r.text for r in dxf.entities(one).where("type = 'TEXT'").collect()] == ["before\xe9\x85\xffafter"]


def test_raster_order_of_encodings():
    data = "图层".encode()
    assert dxf.decode(data) == "图层" and dxf.decode(data, dxf.RASTER_ENCODINGS) == data.decode("gbk") != "图层"


def test_header_and_tables(spark, tmp_path):
    text = "0\nSECTION\n2\nHEADER\n9\n$INSUNITS\n70\n4\n9\n$EXTMIN\n10\n1.5\n20\n-2\n30\n0\n0\nENDSEC\n0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLTYPE\n0\nLTYPE\n2\nDASH\n3\n_ _ _\n0\nSTYLE\n2\nSTD\n40\nx\n0\nENDSEC\n"
    (tmp_path / "a.dxf").write_text(text + HEAD + TAIL)
    r = dxf.read_dxf(spark, str(tmp_path))
    assert sorted((h.variable, h.value) for h in dxf.header(r).collect()) == [("$EXTMIN", "1.5,-2,0"), ("$INSUNITS", "4")]
    assert [(t.name, t.description) for t in dxf.linetypes(r).collect()] == [("DASH", "_ _ _")]
    assert [(t.name, t.height) for t in dxf.styles(r).collect()] == [("STD", None)]
