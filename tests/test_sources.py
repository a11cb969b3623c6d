"""Files: FITS tables and images round trip, text, tiles, streams."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import images
from orrery.sources import fits, text
from orrery.streaming.append import QuotaWriter, counted, filtered


@pytest.fixture(scope="module")
def fs(spark):
    fits.register(spark)
    return spark


def test_table_round_trip(fs, tmp_path):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("ok", T.BooleanType()), T.StructField("name", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("big", T.LongType())])
    rows = [(1, 1.5, True, "a b", [1.0, 2.0], 2**40), (None, -2.0, False, "", [], None), (3, 0.0, None, "é?"[1:], [7.5], -1)]
    df = fs.createDataFrame(rows, schema).repartition(2)
    df.write.format("fits").option("path", f"{tmp_path}/t").mode("append").save()
    back = fs.read.format("fits").option("path", f"{tmp_path}/t").option("rows", 1).load()
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    with pytest.raises(Exception):
        df.write.format("fits").option("path", f"{tmp_path}/t").mode("append").save()
    df.limit(1).write.format("fits").option("path", f"{tmp_path}/t").mode("overwrite").save()
    assert fs.read.format("fits").option("path", f"{tmp_path}/t").load().count() == 1


def image(tmp_path, name="i.fits"):
    data = np.arange(24, dtype=">i2").reshape(4, 6)
    head = fits.header_bytes([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 6), ("NAXIS2", 4), ("BSCALE", 2.0), ("BZERO", 1.0), ("BLANK", 5), ("OBJECT", "it's"), ("HISTORY", "made here")])
    path = tmp_path / name
    path.write_bytes(head + fits.pad(data.tobytes()))
    return str(path), data


def test_image_and_gzip(fs, tmp_path):
    path, data = image(tmp_path)
    df = fs.read.format("fits").option("path", path).option("rows", 7).load()
    got = {(r.i1, r.i2): r.value for r in df.collect()}
    want = {(x + 1, y + 1): None if data[y, x] == 5 else float(data[y, x]) * 2 + 1 for y in range(4) for x in range(6)}
    assert got == want
    packed = tmp_path / "i.fits.gz"
    packed.write_bytes(gzip.compress(open(path, "rb").read()))
    assert fs.read.format("fits").option("path", str(packed)).load().where("i1 = 2 and i2 = 2").first().value == 15.0


def test_header_and_info(fs, tmp_path):
    path, _ = image(tmp_path)
    cards = {(r.keyword, r.n): r.value for r in fits.header(fs, path).collect()}
    assert cards[("OBJECT", 0)] == "it's" and cards[("HISTORY", 0)] == "made here"
    assert fits.info(fs, path).first().dimensions == "6x4"


def test_ascii_table_unsigned_bits_and_scaling(fs, tmp_path):
    rows = ["10.123       37", "    *        23", " 15.61       17"]
    head = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]
    table = [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 15), ("NAXIS2", 3), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TTYPE1", "a"), ("TBCOL1", 1), ("TFORM1", "E10.4"), ("TNULL1", "*"), ("TTYPE2", "b"), ("TBCOL2", 11), ("TFORM2", "I5"), ("EXTNAME", "ASC")]
    raw = np.zeros(2, np.dtype([("u", ">i2"), ("x", "u1", (2,)), ("s", ">i2", (2,))]))
    raw["u"], raw["x"], raw["s"] = [-32768, 32767], [[0b10110000, 0b01000000], [0, 0]], [[1, 2], [3, 4]]
    binary = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 8), ("NAXIS2", 2), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3), ("TTYPE1", "u"), ("TFORM1", "I"), ("TZERO1", 32768), ("TTYPE2", "x"), ("TFORM2", "11X"), ("TTYPE3", "s"), ("TFORM3", "2I"), ("TSCAL3", 0.5), ("TZERO3", 1.0), ("EXTNAME", "BIN")]
    path = tmp_path / "t.fits"
    path.write_bytes(fits.header_bytes(head) + fits.header_bytes(table) + fits.pad("".join(rows).encode(), b" ") + fits.header_bytes(binary) + fits.pad(raw.tobytes()))
    a = fs.read.format("fits").option("path", str(path)).option("ext", "asc").load().collect()
    assert [(round(r.a, 3), r.b) for r in a] == [(10.123, 37), (0.0, 23), (15.61, 17)]
    b = fs.read.format("fits").option("path", str(path)).option("ext", "2").load().collect()
    assert [r.u for r in b] == [0, 65535]
    assert b[0].x == [True, False, True, True, False, False, False, False, False, True, False]
    assert b[1].s == [2.5, 3.0]
    whole = fs.read.format("binaryFile").load(str(path))
    with open(path, "rb") as f:
        schema = fits.schema_of(fits.find_hdu(fits.walk(f), "BIN"))
    assert fits.tables_from_bytes(whole, "BIN", schema).count() == 2
    with pytest.raises(KeyError):
        with open(path, "rb") as f:
            fits.find_hdu(fits.walk(f), "none")


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", [1.5, 2.0]), (2, 'q"', None)], "n int, s string, v array<double>")
    text.dump(df, f"{tmp_path}/data", f"{tmp_path}/columns")
    assert sorted(text.load(spark, f"{tmp_path}/data", f"{tmp_path}/columns").collect()) == sorted(df.collect())


def test_tiles(spark):
    px = spark.createDataFrame([(x, y, x * 10 + y) for x in range(1, 6) for y in range(1, 4) if (x, y) != (2, 2)], "i1 int, i2 int, value int")
    tiles = images.to_tiles(px, 2, 2)
    assert tiles.count() == 6 and tiles.where("t1 = 0 and t2 = 0").first()["values"] == [11, 21, 12, None]
    assert sorted(images.of_tiles(tiles, 2, 2).collect()) == sorted(px.collect())


def test_nulls_text_and_checksums(fs, tmp_path):
    schema = "x double, s string, v array<double>, k long"
    rows = [(None, None, [1.0, None], 5), (1.5, "", [], None), (-2.0, " a b", None, -7)]
    fs.createDataFrame(rows, schema).coalesce(1).write.format("fits").option("path", f"{tmp_path}/t").mode("append").save()
    back = fs.read.format("fits").option("path", f"{tmp_path}/t").load()
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(None, None, [1.0, None], 5), (1.5, "", [], None), (-2.0, " a b", [], -7)], key=str)
    file = next((tmp_path / "t").glob("*.fits"))
    assert [x[2:] for x in fits.verify_checksums(str(file))] == [(None, None), (True, True)]
    data = bytearray(file.read_bytes())
    data[-2000] ^= 1
    (tmp_path / "broken.fits").write_bytes(data)
    assert fits.verify_checksums(str(tmp_path / "broken.fits"))[1][2:] == (False, False)
    for bad in ([("é",)], "s string"), ([(None,), (-(2**63),)], "k long"):
        with pytest.raises(Exception):
            fs.createDataFrame(*bad).coalesce(1).write.format("fits").option("path", f"{tmp_path}/bad").mode("overwrite").save()


@pytest.mark.parametrize("total", [0, 1, 0xFFFFFFFF, 0x12345678, 868229149, 2**31, 2503531142])
def test_checksum_text(total):
    text = fits.checksum_text(total)
    assert text.isalnum() and len(text) == 16
    aligned = text[1:] + text[:1]
    zeros = fits.word_sum(b"0" * 16)
    spread = fits.word_sum(aligned.encode())
    assert fits.word_sum((total).to_bytes(4, "big"), spread - zeros if spread >= zeros else spread + 0xFFFFFFFF - zeros) in (0, 0xFFFFFFFF)


def test_diff_of_files(fs, tmp_path):
    for name, rows in (("a", [(1, 2.0), (2, 3.0), (3, 4.0)]), ("b", [(1, 2.0), (2, 3.5)])):
        fs.createDataFrame(rows, "k int, x double").coalesce(1).orderBy("k").coalesce(1).write.format("fits").option("path", f"{tmp_path}/{name}").mode("append").save()
    a, b = (str(next((tmp_path / n).glob("*.fits"))) for n in "ab")
    assert fits.file_diff(fs, a, a).count() == 0
    got = {tuple(r) for r in fits.file_diff(fs, a, b).collect()}
    assert (1, "rows", "3", "2") in got and (1, "card NAXIS2", "3", "2") in got and (1, "row 2 x", "3.0", "3.5") in got and (1, "row 3", "there", None) in got
    assert fits.header_from_text(fits.header_text([("A", 1, "c"), ("B", "x" * 100, "")]))[:2] == [("A", 1, "c"), ("B", "x" * 100, "")]
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.fits", "w") as z:
        z.write(a, "inner.fits")
    assert fs.read.format("fits").option("path", str(tmp_path / "z.fits")).option("ext", "table,1").load().count() == 3


def test_long_strings_go_on(fs, tmp_path):
    long = "it's " * 40 + "end"
    cards = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("LONG", long, "what"), ("EDGE", "'" * 40 + "x" * 80), ("SHORT", "a/b", "c"), ("HISTORY", "h" * 100)]
    (tmp_path / "long.fits").write_bytes(fits.header_bytes(cards))
    with fits.open_file(str(tmp_path / "long.fits")) as f:
        h = fits.walk(f)[0]
    assert h.header["LONG"] == long and h.header["EDGE"] == "'" * 40 + "x" * 80 and h.header["SHORT"] == "a/b"
    assert [v for k, v, _ in h.cards if k == "HISTORY"] == ["h" * 72, "h" * 28]


def test_stream_quota(spark, tmp_path):
    df = spark.range(6).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = filtered(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), F.col("id") > 1, twice=F.col("id") * 2)
    writer = QuotaWriter(f"{tmp_path}/out", 5, stream.schema)
    q = stream.writeStream.foreachBatch(writer).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    with pytest.raises(ValueError):
        writer(filtered(df, F.col("id") > 1, twice=F.col("id") * 2), 7)
    with pytest.raises(TypeError):
        writer(df, 8)
    assert counted(df, "ts", "2 minutes", "1 minute").count() == 3
