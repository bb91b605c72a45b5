"""Codecs, source and operators over FITS files; byte fixtures are built by hand, without our writer."""

from __future__ import annotations

import gzip
import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hduframe.operators import arrays, interop, mutate, reshape, table, unified
from hduframe.plans import sql
from hduframe.sources import checksum, codecs, layout
from hduframe.sources.header import Card, Header, format_card, index, parse_card
from hduframe.sources.schema import ROW, parse_tform
from hduframe.streaming import arrivals


def card(key, value):
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value else "F") if isinstance(value, bool) else str(value)
    return f"{key:<8}= {text:>20}".ljust(80)


def block(cards):
    text = "".join(cards) + "END".ljust(80)
    return text.encode().ljust(-(-len(text) // 2880) * 2880)


def fixture(path, columns, rows, heap=b"", extra=()):
    """columns: (name, tform); rows: packed bytes of each row."""
    width = len(rows[0])
    head = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", len(rows)), card("PCOUNT", len(heap)), card("GCOUNT", 1), card("TFIELDS", len(columns))]
    for k, (name, tform) in enumerate(columns, 1):
        head += [card(f"TTYPE{k}", name), card(f"TFORM{k}", tform)]
    head += [card(k, v) for k, v in extra]
    data = b"".join(rows) + heap
    with open(path, "wb") as file:
        file.write(block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)]) + block(head) + data.ljust(-(-len(data) // 2880) * 2880, b"\0"))
    return str(path)


def collect(frame):
    return [tuple(r) for r in frame.collect()]


def test_types(spark, tmp_path):
    pack = lambda *v: struct.pack(">c1sBhiq2sfd2f2d5s", *v)
    columns = [("L", "L"), ("X", "3X"), ("B", "B"), ("I", "I"), ("J", "J"), ("K", "K"), ("V", "2B"), ("E", "E"), ("D", "D"), ("C", "C"), ("M", "M"), ("A", "5A")]
    rows = [pack(b"T", b"\xa0", 200, -5, 1 << 20, -(1 << 40), b"\x01\x02", 1.5, -2.25, 1, 2, 3, 4, b"ab \0x"), pack(b"0", b"\x40", 0, 7, 0, 1, b"\0\xff", float("nan"), 0, 0, 0, 0, 0, b"caf\xe9 ")]
    got = table.read(spark, fixture(tmp_path / "a.fits", columns, rows)).collect()
    assert tuple(got[0])[:7] == (True, [True, False, True], 200, -5, 1 << 20, -(1 << 40), bytearray(b"\x01\x02"))
    assert (got[0].E, got[0].D, tuple(got[0].C), tuple(got[0].M), got[0].A) == (1.5, -2.25, (1, 2), (3, 4), "ab")
    assert got[1].L is False and got[1].X == [False, True, False] and got[1].E != got[1].E and got[1].A == "caf"


def test_null_scale_unsigned(spark, tmp_path):
    columns = [("N", "I"), ("S", "I"), ("U", "I"), ("W", "J"), ("NS", "I"), ("VN", "2I")]
    extra = [("TNULL1", -999), ("TSCAL2", 0.5), ("TZERO2", 1.25), ("TZERO3", 32768), ("TZERO4", 2147483648), ("TNULL5", 3), ("TSCAL5", 2.0), ("TNULL6", -999)]
    rows = [struct.pack(">hhhihhh", n, s, u, w, ns, 1, -999) for n, s, u, w, ns in [(1, 1, -32768, -2147483648, 3), (-999, 2, 0, 0, 6), (3, 3, 32767, 2147483647, 1)]]
    path = fixture(tmp_path / "a.fits", columns, rows, extra=extra)
    assert collect(table.read(spark, path)) == [(1, 1.75, 0, 0, None, [1, None]), (None, 2.25, 32768, 1 << 31, 12.0, [1, None]), (3, 2.75, 65535, (1 << 32) - 1, 2.0, [1, None])]
    assert [r.N for r in table.read(spark, path, apply_fits_nulls=False).collect()] == [1, -999, 3]
    assert table.schema(path)["N"].metadata == {"fits_tform": "I", "fits_tnull": -999}


def test_variable_length(spark, tmp_path):
    heap = struct.pack(">iii", 1, 2, 3) + struct.pack(">d", 0.5)
    rows = [struct.pack(">iiqq", 2, 0, 1, 12), struct.pack(">iiqq", 1, 8, 0, 0), struct.pack(">iiqq", 0, 0, 0, 0)]
    got = collect(table.read(spark, fixture(tmp_path / "a.fits", [("P", "1PJ(2)"), ("Q", "1QD")], rows, heap)))
    assert got == [([1, 2], [0.5]), ([3], []), ([], [])]


def test_ascii(spark, tmp_path):
    body = [b"   1    4.50x         ", b"   2    5.50y         ", b"   3 6.5D+00z         "]
    head = [card("XTENSION", "TABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 22), card("NAXIS2", 3), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 3)]
    for k, (n, f, at) in enumerate([("a", "I4", 1), ("b", "F8.2", 5), ("c", "A10", 13)], 1):
        head += [card(f"TTYPE{k}", n), card(f"TFORM{k}", f), card(f"TBCOL{k}", at)]
    path = tmp_path / "a.fits"
    path.write_bytes(block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)]) + block(head) + b"".join(body).ljust(2880))
    assert collect(table.read(spark, str(path))) == [(1, 4.5, "x"), (2, 5.5, "y"), (3, 6.5, "z")]


@pytest.fixture
def star(spark, tmp_path):
    """id, mag, name of 1000 rows, with a primary unit before."""
    path = str(tmp_path / "star.fits")
    frame = spark.createDataFrame([(k, k, k / 10, f"s{k:04d}") for k in range(1000)], f"{ROW} long, id long, mag double, name string").repartition(5)
    interop.write_table(frame, path, extname="STARS", header={"OBSERVER": "me"})
    return path


def test_rows(spark, star):
    ids = lambda **k: [r.id for r in table.read(spark, star, "stars", ["id"], **k).collect()]
    assert ids(row_slice=slice(5, 8)) == [5, 6, 7] and ids(row_slice=(998, 2000)) == [998, 999] and ids(row_slice=slice(7, 3)) == []
    assert ids(rows=[7, 3, 7]) == [7, 3, 7] and ids(rows=[7, 3, 900], where="mag > 50") == [900]
    assert ids(row_slice=slice(0, 10), where="mag >= 0.8") == [8, 9]
    assert ids(where="name == 's0042'") == [42]  # the predicate's column isn't projected
    assert [r.id for r in table.read_rows(spark, star, 1, 3, 2, ["id"]).collect()] == [2, 3]
    for wrong in ({"rows": [-1]}, {"row_slice": slice(0, 9, 2)}, {"row_slice": slice(-3, None)}, {"rows": [1], "row_slice": slice(0, 2)}, {"where": "none > 1"}):
        with pytest.raises(ValueError):
            ids(**wrong)
    with pytest.raises(IndexError):
        ids(rows=[1000])
    with pytest.raises(ValueError):
        table.read_rows(spark, star, 1, 1, 0)
    with pytest.raises(ValueError):
        table.read(spark, star, columns=["none"])
    empty = table.read(spark, star, where="mag < -1")
    assert empty.columns == ["id", "mag", "name"] and empty.count() == 0


def test_window_prunes_partitions(spark, star):
    table.register(spark)
    frame = spark.read.format("hdu").options(row="true", partition_rows="100", start="250", stop="310").load(star)
    assert frame.count() == 60 and frame.rdd.getNumPartitions() == 1


def test_chunks(spark, star):
    assert [b.num_rows for b in table.scan(spark, star, 400)] == [400, 400, 200]
    assert [b.num_rows for b in table.stream_chunks(spark, star, 1, start_row=11, num_rows=50, chunk_rows=30)] == [30, 20]
    assert [b.num_rows for b in table.stream_chunks(spark, star, 1, chunk_rows=100, max_chunks=2)] == [100, 100]
    assert list(table.stream_chunks(spark, star + ".none")) == []
    assert sum(b.num_rows for b in table.read_bounded(spark, star, max_memory_mb=0.01)) == 1000
    assert table.reader(spark, star, columns=["id"]).read_all().num_rows == 1000
    assert table.num_rows(star) == 1000 and table.table_info(star)["string_columns"] == ["name"]


def test_order_and_layouts(spark, star, tmp_path):
    assert [r.id for r in table.read(spark, star).collect()] == list(range(1000))
    folder = str(tmp_path / "many")
    interop.write_table(table.read(spark, star).repartition(3), folder, layout="folder")
    assert len(os.listdir(folder)) == 3 and sorted(r.id for r in table.read(spark, folder).collect()) == list(range(1000))
    with pytest.raises(Exception, match="FileExists|star.fits"):
        interop.write_table(table.read(spark, star), star)
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".part")]


def test_mutations(spark, tmp_path):
    path = str(tmp_path / "m.fits")
    interop.write_table(spark.createDataFrame([(0, 1, "alpha", [1, 2], 1), (1, 2, "beta", [3], 2), (2, 3, "gamma", [4, 5, 6], 3)], f"{ROW} long, ID int, NAME string, V array<int>, Q int"), path, schema={"Q": {"format": "1J", "null": -999}})
    read = lambda: collect(table.read(spark, path, 1))
    mutate.append_file(spark, path, {"ID": [4]})
    assert read()[-1] == (4, "", [], None)
    mutate.insert_file(spark, path, {"ID": [9], "NAME": ["toolongname"], "V": [[7]]}, 1)
    assert read()[1] == (9, "toolo", [7], None) and len(read()) == 5
    mutate.update_file(spark, path, {"V": [[8, 8]], "ID": [10]}, slice(1, 2))
    assert read()[1] == (10, "toolo", [8, 8], None)
    mutate.delete_file(spark, path, (1, 3))
    assert [r[0] for r in read()] == [1, 3, 4]
    mutate.rename_file(spark, path, {"ID": "Q", "Q": "ID"})
    assert table.schema(path).names == ["Q", "NAME", "V", "ID"]
    mutate.drop_columns_file(spark, path, ["V"])
    mutate.insert_column_file(spark, path, "Z", [0.5, 1.5, 2.5], index_=0, unit="mag")
    mutate.replace_column_file(spark, path, "Z", [1.0, 2.0, 3.0])
    assert read()[0] == (1.0, 1, "alpha", 1) and table.schema(path)["Z"].metadata["fits_tunit"] == "mag"
    for wrong, kind in [
        (lambda: mutate.append_file(spark, path, {"none": [1]}), ValueError),
        (lambda: mutate.insert_file(spark, path, {"Q": [1]}, 9), ValueError),
        (lambda: mutate.delete_file(spark, path, 3), ValueError),
        (lambda: mutate.update_file(spark, path, {"Q": [1, 2]}, slice(0, 1)), ValueError),
        (lambda: mutate.insert_column_file(spark, path, "Q", [1, 2, 3]), ValueError),
        (lambda: mutate.replace_column_file(spark, path, "none", [1, 2, 3]), KeyError),
        (lambda: mutate.rename_file(spark, path, {"Q": "NAME"}), ValueError),
        (lambda: mutate.drop_columns_file(spark, path, ["none"]), KeyError),
    ]:
        before = read()
        with pytest.raises(kind):
            wrong()
        assert read() == before


def test_units(tmp_path, spark):
    path = str(tmp_path / "u.fits")
    arrays.write_units(path, [np.arange(6, dtype=np.int16).reshape(2, 3), {"a": [1, 2]}])
    mutate.insert_hdu(path, np.ones((4, 4), np.float32), 1, extname="ONES", compress=True)
    assert [u.kind for u in index(path)] == ["IMAGE", "COMPRESSED_IMAGE", "BINTABLE"]
    mutate.replace_hdu(path, np.zeros((2, 2), np.uint16) + 40000, 1)
    assert arrays.read_image(path, "ones").tolist() == [[40000, 40000]] * 2 and arrays.read_image(path, 0)[1, 2] == 5
    mutate.delete_hdu(path, 1)
    assert len(index(path)) == 2 and "BINTABLE" in arrays.info(path)
    with pytest.raises(IndexError):
        mutate.delete_hdu(path, 7)
    assert arrays.catalog(spark, path).count() == 2 and arrays.headers(spark, path).where("key = 'TTYPE1'").first().value == "a"
    assert arrays.batch_info([path, path + "x"]) == {"num_files": 2, "valid_files": 1}


@pytest.mark.parametrize("dtype", ["uint8", "int8", "int16", "uint16", "int32", "uint32", "int64", "float32", "float64"])
@pytest.mark.parametrize("compress", [False, "rice", "gzip", "gzip_2"])
def test_images(tmp_path, dtype, compress):
    kind = np.dtype(dtype)
    pixels = (np.random.default_rng(1).normal(0, 40, (7, 70)) + (100 if dtype == "uint8" else 0)).astype(kind)
    if kind.kind != "f":
        pixels[0, :2] = np.iinfo(kind).min, np.iinfo(kind).max
    path = str(tmp_path / "i.fits")
    arrays.write_image(path, pixels, compress=compress)
    got = arrays.read_image(path)
    assert got.dtype == kind and np.array_equal(got, pixels)


def test_plio_and_rice_vectors():
    mask = np.array([0, 0, 3, 3, 3, 0, 5000, 1, 1] + [0] * 5000 + [7], np.int32)
    assert np.array_equal(codecs.plio_decode(codecs.plio_encode(mask), len(mask)), mask)
    assert codecs.rice_decode(bytes([0, 5, 0b00000000]), 3, 2).tolist() == [5, 5, 5]  # a block without differences
    # first value 5, code 1 (low bits 0), then folded differences 0, 2, 1: "1", "001", "01"
    bits = format(5, "016b") + "0001" + "1" + "001" + "01"
    assert codecs.rice_decode(int(bits.ljust(32, "0"), 2).to_bytes(4, "big"), 3, 2).tolist() == [5, 6, 5]
    assert abs(codecs.dither_numbers()[-1] * 2147483647 - 1043618065) < 1  # the check value that the standard gives


def star_file(spark, tmp_path):
    interop.write_table(spark.range(20), str(tmp_path / "twenty.fits"))
    return str(tmp_path / "twenty.fits")


def test_cutouts(spark, tmp_path):
    path = str(tmp_path / "c.fits")
    pixels = np.arange(100 * 50, dtype=np.int32).reshape(100, 50)
    arrays.write_image(path, pixels)
    assert np.array_equal(arrays.cutout(path, 0, 3, 90, 9, 200), pixels[90:, 3:9]) and arrays.cutout(path, 0, 9, 9, 9, 20).shape == (0, 0)
    assert np.array_equal(arrays.read_image(f"{path}[0][4:9,11:20]"), pixels[10:20, 3:9])
    lazy = arrays.LazyImage(path)
    assert lazy[-1, 2:5].tolist() == pixels[-1, 2:5].tolist() and lazy[3, 4] == pixels[3, 4]
    with arrays.SubsetReader(path) as one:
        assert one(0, 0, 2, 2).tolist() == pixels[:2, :2].tolist()
    with pytest.raises(ValueError):
        one(0, 0, 1, 1)
    tiles = arrays.tiles(spark, path)
    got = {r.id: r.s for r in arrays.cutouts(tiles, spark.createDataFrame([(1, 3, 90, 9, 200), (2, 0, 0, 1, 1)], "id int, x1 long, y1 long, x2 long, y2 long"), cell=16).groupBy("id").agg({"value": "sum"}).withColumnRenamed("sum(value)", "s").collect()}
    assert got == {1: pixels[90:, 3:9].sum(), 2: 0}
    s = arrays.stats(tiles).first()
    assert (s.pixels, s.min, s.max) == (5000, 0, 4999) and abs(s["mean"] - pixels.mean()) < 1e-9 and abs(s.stddev - pixels.std()) < 1e-9
    assert arrays.tiles(spark, [path, path + ".none"], strict=False).count() == tiles.count()
    one, other = str(tmp_path / "one.fits"), str(tmp_path / "other.fits")
    arrays.write_image(one, np.arange(600, dtype=np.int32).reshape(20, 30))
    arrays.write_image(other, 1000 + np.arange(600, dtype=np.int32).reshape(20, 30))
    named = spark.createDataFrame([(1, one, 0, 2, 3, 5, 7), (2, other, 0, 28, -4, 99, 2)], "id int, path string, hdu int, x1 long, y1 long, x2 long, y2 long")
    got = arrays.cutouts(arrays.tiles(spark, [one, other]), named, cell=4).collect()
    want = {(1, y, x, y * 30 + x) for y in range(3, 7) for x in range(2, 5)} | {(2, y, x, 1000 + y * 30 + x) for y in range(2) for x in (28, 29)}
    assert len(got) == len(want) and {(r.id, r.y, r.x, int(r.value)) for r in got} == want
    assert sum(len(c["id"]) for c in table.stream_arrays(spark, star_file(spark, tmp_path), chunk_rows=7)) == 20


@pytest.mark.parametrize("compress", [False, "rice", "gzip", "gzip_2", "plio"])
def test_lines(spark, tmp_path, compress):
    pixels = np.random.default_rng(2).integers(0, 900, (57, 40)).astype(np.int32)
    rows = spark.createDataFrame([(y, x.tolist()) for y, x in enumerate(pixels)], "y long, pixels array<int>").repartition(5)
    path, whole = str(tmp_path / "l.fits"), str(tmp_path / "w.fits")
    arrays.write_lines(path, rows, "int32", compress)
    arrays.write_image(whole, pixels, compress=compress)
    assert open(path, "rb").read() == open(whole, "rb").read() and np.array_equal(arrays.read_image(path), pixels)
    with pytest.raises(ValueError):
        arrays.write_lines(path, rows.where("y <> 9"), "int32", compress, overwrite=True)
    assert sorted(os.listdir(tmp_path)) == ["l.fits", "w.fits"]


@pytest.mark.parametrize("name", ["image_cutout_sum", "image_stats", "image_rice", "image_gzip", "image_gzip_2", "image_plio", "image_whole_stats"])
def test_catalogue_images_hold_all_parts(spark, tmp_path, monkeypatch, name):
    from hduframe.plans import catalogue

    sizes = np.random.default_rng(3).integers(1, 50, 2010).astype(np.int32)  # more than 1,600, the last line not full
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(sizes)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(catalogue, "_scratch", lambda _: str(tmp_path / "i.fits"))
    catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert np.array_equal(arrays.read_image(str(tmp_path / "i.fits")).reshape(-1), np.append(sizes, np.zeros(30, np.int32)))


def test_scaled_image_and_gzip(tmp_path):
    path = tmp_path / "s.fits"
    head = layout.image_header((2, 2), "int16", True, scale=0.5, zero=10)
    head.set("BLANK", -1)
    path.write_bytes(head.to_bytes() + layout.padded(struct.pack(">4h", 0, 2, -1, 4)))
    got = arrays.read_image(str(path))
    assert got.dtype == np.float32 and got[0].tolist() == [10, 11] and np.isnan(got[1, 0]) and arrays.read_image(str(path), raw=True)[1, 1] == 4
    packed = tmp_path / "s.fits.gz"
    packed.write_bytes(gzip.compress(path.read_bytes()))
    assert arrays.read_image(str(packed))[1, 1] == 12


def test_cards():
    for value in ("it's", "", "x" * 150, "'" * 80, 3, -1.5, 1e300, True, None, 1 + 2j):
        images = format_card(Card("KEY", value, "why"))
        assert all(len(i) == 80 for i in images)
        header = Header.parse("".join(images).encode() + b"END".ljust(80))
        assert header["KEY"] == (value or None if value != "" and not isinstance(value, bool | int | float | complex) else value)
    assert parse_card("HIERARCH ESO TEL = 'big' / name".ljust(80)) == Card("ESO TEL", "big", "name")
    header = Header([Card("HISTORY", "a"), Card("A", 1)])
    header.set("HISTORY", "b")
    header.set("A", 2)
    assert header.many("history") == ["a", "b"] and header["a"] == 2 and len(header.cards) == 3
    for wrong in ("1PC", "Z", "1PM(3)"):
        with pytest.raises(ValueError):
            parse_tform(wrong)
    for name in ("|cmd", "a.fits|", "!|cmd", ""):
        with pytest.raises(ValueError):
            index(name)


def test_checksums(star):
    assert checksum.verify(star, 1)["datastatus"] == 0
    checksum.write(star, 1)
    assert checksum.verify(star, 1) == {"datastatus": 1, "hdustatus": 1, "ok": True}
    with open(star, "r+b") as file:
        file.seek(index(star)[1].data_start + 5)
        file.write(b"\x77")
    assert checksum.verify(star, 1) == {"datastatus": -1, "hdustatus": -1, "ok": False}
    assert checksum.encode(868229149) == "hcHjjc9ghcEghc9g"  # the standard's example


def test_reshape(spark):
    frame = spark.createDataFrame([(0, 1, 2.0), (1, 3, 4.0)], f"{ROW} long, A int, B double")
    assert collect(reshape.add_column(frame, "C", ["x", "y"]).orderBy("A"))[1] == (1, 3, 4.0, "y")
    for wrong, kind in [(lambda: reshape.add_column(frame, "A", [1, 2]), KeyError), (lambda: reshape.add_column(frame, "C", [1]), ValueError), (lambda: reshape.drop_columns(frame, ["none"]), KeyError), (lambda: reshape.rename_column(frame, "A", "B"), KeyError), (lambda: table.head(frame, -1), ValueError), (lambda: reshape.project(frame, ["none"]), ValueError)]:
        with pytest.raises(kind):
            wrong()
    assert [len(b["A"]) for b in reshape.iter_rows(frame, 1)] == [1, 1]


def test_sql_guard(spark, star):
    assert sql.query(spark, star, "SELECT count(*) AS n FROM fits_table WHERE id < 10").first().n == 10
    assert sql.query(spark, star, "EXPLAIN SELECT 1").count() == 1
    spark.range(2).createOrReplaceTempView("u")
    allowed = [
        "WITH a AS (SELECT 1 AS x) SELECT * FROM a JOIN (SELECT 1 AS x UNION SELECT 2) USING (x)",
        "SELECT id, (SELECT max(id) FROM u) AS m FROM fits_table WHERE id IN (SELECT id FROM u) AND EXISTS (SELECT 1 FROM u) ORDER BY id LIMIT 3",
        "SELECT id % 2 AS k, count(*) FROM fits_table GROUP BY ROLLUP (id % 2) HAVING count(*) > 1",
        "SELECT * FROM VALUES (1, 2) AS t(a, b) LATERAL VIEW explode(array(a, b)) AS c",
        "SELECT /*+ BROADCAST(u) */ sum(id) OVER w FROM u WINDOW w AS (ORDER BY id)",
        "SELECT * FROM range(3) PIVOT (count(*) FOR id IN (1, 2))",
        "FROM u |> WHERE id > 0 |> SELECT id",
    ]
    for text in allowed:
        sql.query(spark, star, text).collect()
    for text in (
        "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a",
        "FROM u INSERT INTO t SELECT id INSERT INTO v SELECT id",
        "EXPLAIN INSERT INTO t SELECT 1",
        "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1",
        "DELETE FROM u",
        "MERGE INTO u USING fits_table f ON u.id = f.id WHEN MATCHED THEN DELETE",
        "CACHE TABLE u",
        "ADD JAR 'x.jar'",
        "DROP TABLE fits_table", "SELECT 1; SELECT 2", "INSERT INTO fits_table VALUES (1)", "SHOW TABLES", "CREATE TABLE x AS SELECT 1", "SET a = 1", ""
    ):
        with pytest.raises(ValueError):
            sql.query(spark, star, text)


def test_sql_reads_only_what_it_needs(spark, star):
    def scanned(text):
        result = sql.query(spark, star, text)
        result.collect()
        plan = result._jdf.queryExecution().optimizedPlan()
        leaves = plan.collectLeaves()
        return {a.name() for k in range(leaves.size()) for a in (leaves.apply(k).output().apply(i) for i in range(leaves.apply(k).output().size()))}

    known = set(table.read(spark, star).columns)
    assert len(known) > 2
    assert scanned("SELECT name FROM fits_table WHERE id < 5") <= {"name", "id", ROW} and "name" in scanned("SELECT name FROM fits_table WHERE id < 5")
    assert scanned("SELECT count(*) FROM fits_table WHERE id > 3") <= {"id", ROW}
    assert scanned("SELECT * FROM fits_table") >= known
    got = sql.query(spark, star, "SELECT a.id FROM fits_table a JOIN fits_table b ON a.id = b.id + 1 WHERE b.name = 's0003'").collect()
    assert [r.id for r in got] == [4]
    assert sql.query(spark, star, "SELECT name FROM fits_table WHERE id IN (SELECT max(id) FROM fits_table)").count() == 1


def test_filters_keep_what_spark_keeps(spark, tmp_path):
    rows = [(k, float("nan") if k % 5 == 0 else None if k % 7 == 0 else k / 2, f"t{k % 3}" if k % 4 else None) for k in range(60)]
    frame = spark.createDataFrame(rows, "k long, x double, t string")
    interop.write_table(frame, str(tmp_path / "a.fits"))
    for text in ("x > 10", "x <= 10", "x = 7", "k IN (1, 5, 70)", "t = 't1' AND x >= 3", "NOT x > 4", "x IS NULL", "t IN ('t0', 't2') AND k < 30", "x <> 3"):
        read = table.read(spark, str(tmp_path / "a.fits"))
        want = sorted(r.k for r in spark.createDataFrame(read.collect(), read.schema).where(text).collect())
        assert sorted(r.k for r in read.where(text).collect()) == want, text
        assert sorted(r.k for r in sql.query(spark, str(tmp_path / "a.fits"), f"SELECT k FROM fits_table WHERE {text}").collect()) == want, text
    plan = sql.query(spark, str(tmp_path / "a.fits"), "SELECT t FROM fits_table WHERE k >= 7 AND 9 > k AND x > 1")._jdf.queryExecution().optimizedPlan()
    assert sorted(sql._comparisons(plan, ["k", "x", "t"])) == [("k", "<", 9), ("k", ">=", 7), ("x", ">", 1.0)]


def test_one_frame_with_two_filters(spark, star):
    """Rows that one use of a DataFrame leaves out are there for the other."""
    frame = table.read(spark, star, with_row=True)
    assert frame.where(F.col(ROW) < 10).unionByName(frame.where(F.col(ROW) >= 5)).count() == 1005
    frame.createOrReplaceTempView("twice")
    assert [r.id for r in spark.sql("SELECT a.id FROM twice a JOIN twice b ON a.id = b.id + 1 WHERE b.id = 3").collect()] == [4]


def test_folder_commit_moves_no_rows(spark, tmp_path, monkeypatch):
    from hduframe.sources import fits_source

    frame = spark.range(100).repartition(4)
    schema = frame.schema
    writer = fits_source.TableWriter({"path": str(tmp_path / "out"), "layout": "folder"}, schema, True)
    os.makedirs(writer.work)
    for k in range(2):  # what tasks leave
        with open(f"{writer.work}/{k:06d}-{k}.fits", "wb") as file:
            file.write(b"x")
    monkeypatch.setattr(fits_source.TableWriter, "_unit", None)
    writer.commit([fits_source.Part(f"{writer.work}/{k:06d}-{k}", k, 50, 400, 0) for k in (1, 0)])
    assert sorted(os.listdir(tmp_path / "out")) == ["part-000000.fits", "part-000001.fits"]
    monkeypatch.undo()
    interop.write_table(frame, str(tmp_path / "whole"), layout="folder")
    assert sorted(r.id for r in table.read(spark, str(tmp_path / "whole")).collect()) == list(range(100))


def test_unified_read_and_validate(spark, star, tmp_path):
    path = str(tmp_path / "i.fits")
    arrays.write_image(path, np.arange(12, dtype=np.int16).reshape(3, 4))
    assert unified.read(spark, [path, path]).count() == 2 and unified.read(spark, star).count() == table.num_rows(star)
    assert unified.read(spark, path, mode="image").columns[0] == "path" and not unified.validate(star) and not unified.validate(path)
    with pytest.raises(ValueError):
        unified.read(spark, path, mode="both")
    with open(path, "rb") as file:
        whole = file.read()
    with open(path, "wb") as file:
        file.write(whole[:2880])
    assert unified.validate(path)


def test_interop(spark, star, tmp_path):
    data = {"a": np.array([1, 2]), "z": np.array([1 + 2j, 3j], np.complex64), "t": np.frombuffer(b"ab  cd  ", np.uint8).reshape(2, 4), "v": [[1], [2, 3]]}
    assert interop.arrays_to_arrow(data, decode_bytes=True)["t"].to_pylist() == ["ab", "cd"]
    assert "v" not in interop.arrays_to_pandas(data, vla_policy="drop")
    with pytest.raises(ValueError):
        interop.arrays_to_arrow(data, vla_policy="none")
    assert interop.frame_from(spark, pa.table({"a": [1]}).to_batches()).count() == 1
    interop.write_parquet(table.read(spark, star), str(tmp_path / "p.parquet"))
    assert table.read(spark, str(tmp_path / "p.parquet"), where="id == 7").first().name == "s0007"
    assert len(list(interop.to_pandas(table.read(spark, star), stream=True, batch_size=300))) == 4


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, low: interop.write_table(spark.range(low, low + 5), str(folder / name))
    write("a.fits", 0)
    query = arrivals.read_stream(spark, str(folder), where="id != 3").writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    write("b.fits", 10)
    os.utime(folder / "b.fits", (1, 1))  # older than the first
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.table("arrived").collect()) == [0, 1, 2, 4, 10, 11, 12, 13, 14]
