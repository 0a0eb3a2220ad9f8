"""A drawing is read piece by piece: the same records as from the whole text, in little memory."""

import re
import tracemalloc

from planwright.sources import dxf


def test_lines_are_those_of_the_whole_text(monkeypatch):
    texts = ["", "a", "a\r\n", "a\r\r\nb\rc\n\n", "图层\r\nx\u0085  y\n", "é" * 9 + "\n" + "z" * 40]
    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(dxf, "PIECE", size)
        for text in texts:
            for e in ("utf-8", "gbk"):
                try:
                    data = text.encode(e)
                except UnicodeEncodeError:
                    continue
                for order in (dxf.ENCODINGS, dxf.RASTER_ENCODINGS, ("utf-8",)):
                    assert list(dxf.lines_of(memoryview(data), order)) == re.split(r"\r?\n", dxf.decode(data, order))


def test_memory_does_not_grow_with_the_drawing():
    body = "0\nLINE\n8\nL\n10\n1\n20\n2\n" * 200_000
    data = ("0\nSECTION\n2\nENTITIES\n" + body + "0\nENDSEC\n").encode()
    tracemalloc.start()
    n = sum(1 for _ in dxf.rows_of("f", memoryview(data), dxf.ENCODINGS, "permissive"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 40 << 20  # the list of all lines alone is over 100 MB


def test_named_tables_in_one_pass(spark, tmp_path):
    text = "0\nSECTION\n2\nTABLES\n0\nLTYPE\n2\nDASH\n3\n_ _\n0\nSTYLE\n2\nA\n40\nx\n0\nSTYLE\n2\nB\n40\n2.5\n0\nDIMSTYLE\n2\nISO\n0\nENDSEC\n0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB1\n0\nSTYLE\n2\nno\n0\nENDBLK\n0\nENDSEC\n"
    (tmp_path / "a.dxf").write_text(text)
    got = dxf.all_named(dxf.read_dxf(spark, str(tmp_path)))
    assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == ["('block', 'B1', None)", "('dimstyle', 'ISO', None)", "('linetype', 'DASH', '_ _')", "('style', 'A', None)", "('style', 'B', '2.5')"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
