"""Golden rows and differential checks of the text rules."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from postgeo.functions import extract, fixed as X, labels, places
from postgeo.operators import ingest, segment


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t STRING").select(col(F.col("t")).alias("r")).first()["r"]


def wage(spark, text):
    def both(c):
        lo, hi = extract.wage_from_numbers(extract.wage_numbers(c))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return tuple(one(spark, text, both))


def test_wage(spark):
    assert wage(spark, "$18-20/hr") == (18, 20)
    assert wage(spark, "$18/hr") == (18, 18)
    assert wage(spark, "$1,800") == (1800, 1800)
    assert wage(spark, "$18.50/hr") == (18, 50)
    assert wage(spark, "No pay info") == (None, None)
    assert wage(spark, "$18/hr call 604-555-1234") == (18, 1234)
    assert wage(spark, "時給１８ドル") == (18, 18)
    assert wage(spark, "9" * 30) == (extract.BIGINT_MAX, extract.BIGINT_MAX)


def test_category_city_date(spark):
    assert one(spark, "Workshop helper", lambda c: extract.category(c, F.lit(""))) == "retail"
    assert one(spark, "Hotel cook", lambda c: extract.category(c, F.lit(""))) == "restaurant"
    assert one(spark, None, lambda c: extract.category(c, c)) == "other"
    assert one(spark, "North Vancouver", extract.city_hint) == "Vancouver"
    assert str(one(spark, "2024-13-01 and 01/15/2024", extract.posted_date)) == "2024-01-15 00:00:00"
    assert one(spark, "0000-01-01", extract.posted_date) is None


def test_author_place_is_never_needed(spark):
    # a name/place pair lies inside the body, so a body without a city has none there either
    assert one(spark, "posted by Ken/Nowhere", extract.city_hint) is None


def test_location_text(spark):
    row = spark.createDataFrame([("10 King St, Foo", None, "Toronto")], "a STRING, s STRING, h STRING")
    got = row.select(extract.location_text(F.col("a"), F.col("s"), F.col("h")).alias("r")).first()["r"]
    assert got == "10 King St, Foo, Toronto, BC"


def test_store_name(spark):
    df = spark.createDataFrame([("Mika Sushi hiring", "text"), ("Help", "店名：虹カフェ東\nx"), ("Help", "come to Joe's Big Pizza now")], "t STRING, b STRING")
    got = [r["r"] for r in df.select(extract.store_name(F.col("b"), F.col("t")).alias("r")).collect()]
    assert got == ["Mika Sushi hiring", "虹カフェ東", "s Big Pizza"]


ADDRESS_ROWS = [
    # text, all rules, strict rules
    ("Address: 10 King Street, Vancouver BC", ["10 King Street, Vancouver BC", "King Street, Vancouver BC"], ["10 King Street, Vancouver BC"]),
    ("Location: a@b.c", [], []),
    ("Address: http://x.y/zzzz", [], []),
    ("Address: abc", [], []),
    ("come to 4518 Hastings St, Burnaby BC now", ["4518 Hastings St, Burnaby BC now", "Hastings St, Burnaby BC now"], ["4518 Hastings St, Burnaby BC now"]),
    ("Joy Cafe, 55 Main Rd, Surrey", ["55 Main Rd, Surrey", "Main Rd, Surrey", "Joy Cafe, 55 Main Rd, Surrey"], ["55 Main Rd, Surrey"]),
    ("Yaletown Vancouver", ["Yaletown Vancouver"], ["Yaletown Vancouver"]),
    ("Oak Bay, Victoria", [], []),
    ("Surrey・Langleyエリア", ["Surrey・Langleyエリア"], ["Surrey・Langleyエリア"]),
    ("must be strong", ["must be strong"], []),
    ("work location: 7b Oak Ave, Delta", ["7b Oak Ave, Delta", "b Oak Ave, Delta"], ["7b Oak Ave, Delta"]),
    ("no address here", [], []),
]


def test_address_rows(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ADDRESS_ROWS)], "i INT, t STRING")
    for mode, at in (("reference", 1), ("strict", 2)):
        got = {r["i"]: r["a"] for r in extract.with_addresses(df, "t", "a", mode).collect()}
        for i, row in enumerate(ADDRESS_ROWS):
            assert got[i] == row[at], row[0]


def test_address_properties(spark):
    """Any text: what is found stands in it, is unique by letters, long enough, and no link."""
    rng = random.Random(7)
    bits = [
        "12", "4518 ", "7b ", "Hastings ", "st", " St, ", "Street ", "AVE", "road ", " rd ", ", ", ",,", "\n", "  ", "　", "Burnaby",
        "V5C 2K4", "BC", "Address: ", "location ", "勤務地：", "Cafe, ", "Sushi ", "& ", "Yaletown Vancouver", "Surrey・Langleyエリア",
        "north/south area", "x@y.z", "http://a", "must be ", "é", "5", "Kingſt ", "Work Location: ", "１２ ",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").repartition(8)
    squeezed = [re.sub(r"[\s,]+", "", t) for t in texts]
    for r in extract.with_addresses(df, "t", "a").collect():
        low = [a.lower() for a in r["a"]]
        assert len(set(low)) == len(low)
        assert all(len(a) > 5 and a == a.strip() for a in r["a"])
        assert all(re.sub(r"[\s,]+", "", a) in squeezed[r["i"]] for a in r["a"])
    labelled = extract.with_addresses(df.select("i", F.concat(F.lit("Address: @"), "t").alias("t")), "t", "a")
    assert not any("@" in a.split("\n")[0][:1] for r in labelled.collect() for a in r["a"])


def test_many_address_lines(spark):
    text = "\n".join(f"Address: {i} Main Street, Vancouver" for i in range(8000))
    got = extract.with_addresses(spark.createDataFrame([(text,)], "t STRING"), "t", "a").first()["a"]
    assert got[:2] == ["0 Main Street, Vancouver", "1 Main Street, Vancouver"] and len(got) > 8000


def test_long_mail_address(spark):
    mail = "a" * 90 + "@" + ".".join("x" * 5 for _ in range(14)) + ".example"
    df = spark.createDataFrame([(f"write to {mail}, please",)], "t STRING")
    want = hashlib.sha256(f"mail:{mail}".encode()).hexdigest()
    assert df.select(extract.contact_hashes(F.col("t")).alias("h")).first()["h"] == [want]


def test_long_run_is_linear(spark):
    text = "a " * 60000 + "1"
    df = spark.createDataFrame([(text,)], "t STRING")
    assert extract.with_addresses(df, "t", "a").first()["a"] == []


def test_labels(spark):
    df = spark.createDataFrame([(0, 20, 0.7)], "lo INT, hi INT, c DOUBLE")
    r = df.select(labels.wage_label(F.col("lo"), F.col("hi")).alias("w"), labels.confidence_label(F.col("c")).alias("c")).first()
    assert tuple(r) == ("Up to $20/hr", "높음")
    assert one(spark, None, lambda c: labels.title_label(c)) == X.LABEL_NO_TITLE


def test_places(spark):
    assert tuple(one(spark, "Langley", places.region_center)) == (49.2827, -123.1207, 0.5)
    assert one(spark, "0.7", lambda c: places.confidence(c.cast("double"))) == 0.8
    assert one(spark, " 12  Main St.", places.norm_location) == "12 main street"


PAGE = (
    "<html><body><h2>Board</h2><div>No.12</div><h2>Cook wanted</h2><p>We need a cook for evenings and weekends in Vancouver.</p>"
    "<p>Pay is $18/hr</p><div>no.13</div><p>short</p><div>No.12</div><p>again</p><!-- >No.99 --></body></html>"
)


def test_segments(spark):
    df = spark.createDataFrame([("u", 4, PAGE)], "url STRING, bbs INT, html STRING").withColumn("fetched_at", F.current_timestamp())
    rows = {r["msgid"]: r for r in segment.segment_posts(df).collect()}
    assert sorted(rows) == [12, 13]
    assert rows[12]["title"] == "Cook wanted" and rows[12]["body_source"] == "blocks"
    assert rows[12]["body"] == "We need a cook for evenings and weekends in Vancouver. Pay is $18/hr"
    assert rows[13]["title"] is None and rows[13]["body_source"] == "page"


def posts_of(spark, *pages):
    rows = [(f"http://x/topics.php?msgid={n}", 4, html) for n, html in pages]
    df = spark.createDataFrame(rows, "url STRING, bbs INT, html STRING").withColumn("fetched_at", F.current_timestamp())
    return {r["msgid"]: r for r in segment.segment_posts(df).collect()}


def test_marker_inside_a_text(spark):
    html = "<html><body><td>[12] No.12 2024</td><p>We look for a friendly cook, evenings and weekends.</p><td>[13] No.13 2024</td><p>other</p></body></html>"
    rows = posts_of(spark, (12, html))
    assert list(rows) == [12] and rows[12]["body"].startswith("We look for a friendly cook")


def test_container_ends_at_its_own_tag(spark):
    long = "a long text that goes on behind the inner element, well over fifty"
    rows = posts_of(spark, (20, f'<body><div class="content"><div>inner</div>{long}</div>tail</body>'), (21, f'<body>head<div class="content">{long}<DIV></body>'))
    assert (rows[20]["body"], rows[20]["body_source"]) == ("inner" + long, "container")
    assert rows[21]["body_source"] == "page"


def test_body_from_the_whole_segment(spark):
    loose = "x1 <b>y2</b> z3 " * 5
    rows = posts_of(spark, (30, f"<body><div>No.30 {loose}<h2>Cook</h2></body>"))
    assert rows[30]["title"] == "Cook" and rows[30]["body_source"] == "segment" and len(rows[30]["body"]) >= 50


def test_refused_posts_and_nameless_records(spark):
    df = spark.createDataFrame([("u", 1, "", None), ("u", None, "t", "b"), ("u", 2, "t", None)], "url STRING, msgid BIGINT, title STRING, body STRING")
    assert {(r["msgid"], r["code"]) for r in ingest.parse_rejects(df).collect()} == {(1, "PARSE_FAILED"), (None, "PARSE_FAILED")}
    rec = spark.createDataFrame([(None, 1), ("u", None), ("u", 1)], "source_url STRING, msgid BIGINT").selectExpr("*", "49d lat", "-123d lng", "1 wage_min", "2 wage_max")
    assert [r["c"] is None for r in rec.select(ingest.reject_code().alias("c")).collect()] == [False, False, True]


def test_listing(spark):
    html = '<a href="topics.php?msgid=7">No.9</a><a href="x?bbs=1&msgid=11">.</a><script>No.5</script> No.7'
    assert one(spark, html, segment.listing_msgids) == [11, 9, 7]


def test_facts_drop_the_body(spark):
    df = spark.createDataFrame([("u", 1, "Cook", "pay $20 in Banff")], "source_url STRING, msgid BIGINT, title STRING, body STRING")
    got = ingest.extract_facts(df)
    assert "body" not in got.columns
    r = got.first()
    assert (r["wage_min"], r["category"], r["region_hint"], r["location_text"]) == (20, "restaurant", "Banff", "Banff, BC")


def test_addresses_of_anchored_pieces_equal_those_of_whole_texts(spark, monkeypatch):
    """The same rules over whole texts and over their anchored pieces."""
    rng = random.Random(17)
    words = [
        "12 Main Street", "Main St", "st", "1884 Dayton st", "Kelowna", "BC", "V5C 2K4", "best", "first", "ſtreet", "Rd", "ROAD", "Ave", "avenue", "Lane", "way", "Blvd",
        "Joy Cafe", "Ramen", "Market", "Yaletown", "Vancouver", "Surrey", "Langley", "エリア", "area", "・", "/", "&", ",", ".", "\n", "\t", "　", " ", "é", "İ", "ı", "K", "\u0001",
        "-", "：", "勤務地：", "Address:", "Address", "Work Location", "mail@x.org", "http://x", "77", "７", "town", "Parkland", "日本語", "$18", "a", "The",
    ]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "", ", "]) for _ in range(rng.choice([3, 12, 60])))) for i in range(600)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "i INT, t STRING").repartition(4)
    for mode in ("reference", "strict"):
        got = {r["i"]: r["a"] for r in extract.with_addresses(df, "t", "a", mode).collect()}
        with monkeypatch.context() as m:
            m.setattr(extract, "pieces", lambda t: F.array(t))
            m.setattr(extract, "anchored", lambda texts, low, anchors: F.get(texts, F.lit(0)))
            want = {r["i"]: r["a"] for r in extract.with_addresses(df, "t", "a", mode).collect()}
        assert got == want and sum(bool(a) for a in want.values()) > 100
