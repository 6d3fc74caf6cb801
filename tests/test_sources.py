import json

from pyspark.sql import functions as F

from pinfold.sources import documents as D
from pinfold.sources import web as W
from pinfold.sources.paged import PagedFeatures
from pinfold.streaming.gap_fill import stream_gap_fill


def test_places_round_trip(spark):
    text = json.dumps({"k": ["christian"], "p": [["A", 0, 40.1, -75.0, "KY", "C", ""], ["B", 1, "bad", -75.0, "KY", "C", "T", "21151"], ["short"]]})
    df = D.decode_places(spark.createDataFrame([(text,)], "value string"))
    got = df.orderBy("row_id").collect()
    assert [(r.row_id, r.name, r.lat, r.fips) for r in got] == [(0, "A", 40.1, ""), (1, "B", None, "21151")]
    rows = [json.loads(r.value) for r in D.encode_places(df.where("row_id = 0")).collect()]
    assert rows[0][:2] == ["A", "0"]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc"), (2, None)], "i int, t string")
    D.write_tsv(df, str(tmp_path / "t"))
    assert sorted((r.i, r.t) for r in D.read_tsv(spark, str(tmp_path / "t"), "i int, t string").collect()) == [(1, "a b c"), (2, None)]
    D.write_rows(df, str(tmp_path / "j"))
    again = spark.read.schema(df.schema).json(str(tmp_path / "j"))
    assert D.content_digest(again) == D.content_digest(df.orderBy(F.desc("i"))) != D.content_digest(df.limit(1))


def test_overpass_and_geocodes(spark, tmp_path):
    path = tmp_path / "o.json"
    rows = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "n", "religion": "x"}}, {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "n", "religion": "x"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {}}, {"type": "way", "id": 3, "tags": {}}]
    path.write_text("\n".join(map(json.dumps, rows)))
    got = sorted((r.osm, r.name, r.lat) for r in D.read_overpass(spark, str(path)).collect())
    assert got == [("node/1", "n", 1.0), ("way/2", "", 3.0)]
    cache = spark.createDataFrame([("1 main st", 1.0, 2.0)], "address_key string, lat double, lon double")
    asked = spark.createDataFrame([("1  Main St",), ("PO Box 3",), ("",), ("2 x",), (None,)], "address string")
    assert sorted(r.status for r in D.with_cached_geocodes(asked, cache).collect()) == ["empty", "empty", "nomatch", "ok", "pobox"]


def test_place_pages(spark):
    pages = [
        ("u1", '<title>Churches</title>'),
        ("u2", '<h1 class="x">Grace <b>Church</b> - State Convention of X</h1><div class="church_mailing_addy">PO Box 1<br/>Berea, KY 40403</div><div class="church_meeting_addy">5 Oak St<br>Berea, KY 40404</div><i class="marker" data-lat="37.5" data-lng="-84.3">'),
        ("u3", "<title>Hope | Site</title> 12 Elm Road, Berea, KY 40403 <i data-lat='x'>"), ("u4", "<title>Box</title>PO Box 77, Berea KY 40403"), ("u5", None),
    ]
    rows = {r.url: r for r in W.parse_place_page(spark.createDataFrame(pages, "url string, html string"), "url", "html").collect()}
    assert set(rows) == {"u2", "u3", "u4"}
    assert (rows["u2"].name, rows["u2"].address, rows["u2"].zip, rows["u2"].lat, rows["u2"].lon) == ("Grace Church", "5 Oak St, Berea, KY 40404", "40404", 37.5, -84.3)
    assert rows["u3"].name == "Hope" and rows["u3"].address.startswith("12 Elm Road") and rows["u3"].lat is None
    assert rows["u4"].address == "PO Box 77, Berea KY 40403"
    kept = W.near_place(spark.createDataFrame([("x", "40403", None, None, "u"), ("a, Berea KY", "", None, None, "u"), ("", "", 37.6, -84.2, "u"), ("", "", None, None, "/paint-lick/"), ("", "", None, None, "u")], "address string, zip string, lat double, lon double, url string"), ["40403"], "berea|richmond", (37.55, 37.95, -84.55, -84.05), ["paint-lick"])
    assert kept.count() == 4
    points = W.parse_points(spark.createDataFrame([("lat:40.0,lon:-75.0,n:A,s:a; lat:10.0,lon:5.0,n:B,s:b; lat:20.0,lon:-157.0,n: ,s:c",)], "html string"), "html", r"lat:([-\d.]+),lon:([-\d.]+),n:([^,]*),s:(\w+)")
    assert [(r.name, r.slug) for r in points.collect()] == [("A", "a")]


def pages_of(offset, size, columns):
    return [{"NAME": f"n{i}", "X": float(i)} for i in range(offset, min(offset + size, 25))]


def test_paged_source(spark):
    spark.dataSource.register(PagedFeatures)
    df = spark.read.format("paged_features").schema("NAME string, X double, Y double").option("fetch", "tests.test_sources:pages_of").option("total", "25").option("page", "10").load()
    rows = df.collect()
    assert len(rows) == 25 and {r.NAME for r in rows} == {f"n{i}" for i in range(25)} and rows[0].Y is None


def test_streaming_gap_fill(spark, tmp_path):
    pin = "row_id long, rel int, lat double, lon double"
    source, held = str(tmp_path / "in"), str(tmp_path / "held")
    spark.createDataFrame([(1, 0, 40.0, -75.0)], pin).write.parquet(held)
    spark.createDataFrame([(11, 0, 40.001, -75.0), (12, 0, 40.2, -75.0)], pin).write.parquet(source)
    external = spark.readStream.schema(pin).parquet(source)
    query = stream_gap_fill(external, lambda: spark.read.parquet(held), lambda gaps, n: gaps.write.mode("append").parquet(held), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(r.row_id for r in spark.read.parquet(held).collect()) == [1, 12]


def shapefile(folder, stem, shapes, rows):
    import struct

    body = b""
    for k, s in enumerate(shapes):
        if s is None:
            rec = struct.pack("<I", 0)
        elif len(s) == 2:
            rec = struct.pack("<I2d", 1, *s)
        else:
            xs, ys = [p[0] for p in s], [p[1] for p in s]
            rec = struct.pack("<I4d2I", 5, min(xs), min(ys), max(xs), max(ys), 1, len(s)) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in s)
        body += struct.pack(">2I", k + 1, len(rec) // 2) + rec
    (folder / f"{stem}.shp").write_bytes(b"\0" * 100 + body)
    fields = [("osm_id", 8), ("name", 12), ("fclass", 10)]
    head = struct.pack("<4BIHH20x", 3, 26, 1, 1, len(rows), 32 + 32 * len(fields) + 1, 1 + sum(w for _, w in fields))
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", w, 0) for n, w in fields) + b"\r"
    data = b"".join(b" " + b"".join(str(v).encode().ljust(w) for v, (_, w) in zip(r, fields)) for r in rows)
    (folder / f"{stem}.dbf").write_bytes(head + data)


def test_shapefiles_and_sheets(spark, tmp_path):
    import zipfile

    from pinfold.sources.shapefile import Shapefiles, Sheets

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    shapefile(tmp_path, "a_pofw", [(-84.0, 37.0), square, None], [("1", "Grace é", "christian"), ("2", "Area", "muslim"), ("3", "none", "x")])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for end in ("shp", "dbf"):
            z.write(tmp_path / f"a_pofw.{end}", f"in/a_pofw.{end}")
            z.write(tmp_path / f"a_pofw.{end}", f"in/roads.{end}")
    spark.dataSource.register(Shapefiles)
    df = spark.read.format("shapefile").option("layer", "pofw").load(f"{tmp_path}/a_pofw.shp,{tmp_path}/z.zip")
    rows = sorted(tuple(r) for r in df.collect())
    assert len(rows) == 4 and rows[0] == ("1", "Grace é", "christian", "point", 37.0, -84.0, 0.0, 0.0)
    assert rows[2][3:] == ("area", 0.8, 1.6, 2.0, 4.0)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Head</t></si><si><r><t>Al</t></r><r><t>len</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>1001.0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    spark.dataSource.register(Sheets)
    assert [tuple(r) for r in spark.read.format("sheet").load(f"{tmp_path}/s.xlsx").collect()] == [("1001.0", None, "Allen", "x", None, None)]


def test_forms_for_display(spark):
    from pinfold.functions import present as P

    row = spark.range(1).select(
        P.state_code(F.lit("New-York")).alias("a"), P.state_code(F.lit("delaware")).alias("b"), P.state_code(F.lit("District of Columbia")).alias("c"), P.state_code(F.lit("x")).alias("d"), P.state_code(F.lit("Wyoming")).alias("w"),
        P.grouped(F.lit(1234567)).alias("e"), P.rgba(F.lit("#0a10ff"), F.lit(0.5)).alias("f"), P.map_link(F.lit(1.5), F.lit(-2.5), F.lit("a b"), "https://m").alias("g"),
        P.coordinate_line(F.lit("n"), F.lit(1.0), F.lit(2.0)).alias("h"), P.next_in_stack(F.lit(2), F.lit(3)).alias("i"),
    ).first()
    assert tuple(row) == ("NY", "DE", "DC", None, "WY", "1,234,567", "rgba(10,16,255,0.5)", "https://m?ll=1.5,-2.5&q=a+b", "n (1.00000, 2.00000)", 0)


def test_caches_optional_sources_tiles_and_links(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(500)

    path = str(tmp_path / "pull")
    assert D.cached(spark, path, build).count() == D.cached(spark, path, build).count() == 500 and len(built) == 1
    D.cached(spark, path, build, least_bytes=10**9)
    assert len(built) == 2
    assert D.optional(spark, str(tmp_path / "none"), "a int").count() == 0 and D.optional(spark, path, "id long").count() == 500
    assert D.tiles((0.0, 2.0, 0.0, 4.0)) == [(0.0, 1.0, 0.0, 2.0), (0.0, 1.0, 2.0, 4.0), (1.0, 2.0, 0.0, 2.0), (1.0, 2.0, 2.0, 4.0)]
    maps = spark.createDataFrame([("<loc>http://a/church/2</loc><loc> http://a/church/1 </loc><loc>http://a/church/1</loc><loc>http://a/blog</loc><loc>http://a/church/page</loc>",)], "t string")
    assert [r.url for r in W.links(maps, "t", "http://a/church/", without="page$").collect()] == ["http://a/church/1", "http://a/church/2"]
    text = spark.createDataFrame([(r"Café \"X\" \/ O\'Neil\nend",)], "t string")
    assert text.select(W.unescaped(F.col("t")).alias("u")).first().u == "Café \"X\" / O'Neil end"


def test_lookups_by_place_and_failed_geocodes(spark):
    points = spark.createDataFrame([(1, 40.0, -75.0), (2, 41.0, -75.0)], "row_id long, lat double, lon double")
    known = spark.createDataFrame([(7, 40.0001, -75.0, "here"), (8, 40.0003, -75.0, "there")], "row_id long, lat double, lon double, display string")
    assert [r.display for r in D.with_reverse_geocodes(points, known).orderBy("row_id").collect()] == ["here", None]
    rows = spark.createDataFrame([("1 A St",), ("2 B St",), (" ",)], "address string")
    cache = spark.createDataFrame([("1 a st", None, None, "error")], "address_key string, lat double, lon double, status string")
    assert sorted(r.status for r in D.with_cached_geocodes(rows, cache).collect()) == ["empty", "error", "nomatch"]


def short_pages(offset, size, columns):
    return [{"NAME": f"n{i}"} for i in range(offset, min(offset + size, 7))]


def test_paged_source_stops_on_a_short_page(spark):
    spark.dataSource.register(PagedFeatures)
    df = spark.read.format("paged_features").option("fetch", "tests.test_sources:short_pages").option("page", "3").schema("NAME string").load()
    assert sorted(r.NAME for r in df.collect()) == [f"n{i}" for i in range(7)]
