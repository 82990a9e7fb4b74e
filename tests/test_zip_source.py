"""The ZIP data source, the page stream and detection."""

import json
import random
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from hearthlog.sources import archives, html_records, zip_source

HOSTILE = """<html><head><title>T é漢\U0001f600 &amp; x</title><style>.no{}</style></head><body><h1>Me &#233; you</h1>stray</p><table><tr><th>Works at</th><td>Ac<b>me</b></td></tr></table>
<section class="_a6-g" data-post-id="p&amp;1"><h2 class="_a6-h x">Ann<!-- no --> Bee</h2><div class="_a6-p">Hello <b>you<script>var a = "</p>leak" && '<b>';</script></b>&nbsp;&copy &unknown; a<br>b</div><time datetime="2024-05-06">x</time><a href="https://facebook.com/a?x=1&amp;y=2">l</a><img src="../m/a%20b.jpg"></section>
<img src=loose.jpg><section class="_a6-g"><template>secret</template><div class="_a72d">May 6, 2024</div>tail &lt;x <"""


def whole(html, size):
    data = html.encode()
    out = [row for row, _ in html_records.streamed(data[k : k + size] for k in range(0, len(data), size))]
    return json.dumps(out, default=str)


def test_a_page_is_the_same_at_every_chunk_size():
    want = whole(HOSTILE, 10**9)
    assert "leak" not in want and "secret" not in want and "é漢\\ud83d" not in want
    page = html_records._page(HOSTILE)
    assert page["title"] == "T é漢\U0001f600 & x" and page["h1"] == "Me é you" and page["rows"] == [["Works at", "Acme"]] and [c["heading"] for c in page["cards"]] == ["Ann Bee", None]
    assert page["cards"][0]["body"] == "Hello you © &unknown; a b l" and page["cards"][0]["attributes"] == [("data-post-id", "p&1")]
    for size in (1, 2, 3, 5, 7, 64, 1000):
        assert whole(HOSTILE, size) == want
    rnd = random.Random(3)
    bits = ["<section class='_a6-g'>", "</section>", "<div class=_a6-p>", "</div>", "té漢", " ", "&am", "p;", "<", ">", "<script>", "</script>", "<!--", "-->", "<tr><td>", "</td></tr>", "\n", "<img src=x>", "<h1>"]
    for _ in range(30):
        text = "".join(rnd.choice(bits) for _ in range(3000)) + "x" * rnd.choice([0, 70_000])
        want = whole(text, 10**9)
        assert all(whole(text, n) == want for n in (1, 17, 4096))


def test_a_huge_page_needs_little_memory():
    """512 MiB of cards, of one text, of a script and of a tag without an end, in a process of its own."""
    program = """
import resource, sys
from hearthlog.sources import html_records
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
card = b"<section class='_a6-g'><h2>Name</h2><div class='_a6-p'>" + b"word " * 2000 + b"</div><img src='a.jpg'></section>"
kinds = {"cards": (b"", card), "text": (b"<section class='_a6-g'>", b"word " * 3000), "script": (b"<script>", b"var x; " * 3000), "tag": (b"<a b='", b"c" * 20000)}
head, block = kinds[sys.argv[1]]
def chunks():
    yield head
    for _ in range((int(sys.argv[2]) << 20) // len(block)):
        yield block
n = sum(1 for _ in html_records.streamed(chunks()))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    for kind, mib in (("cards", 512), ("text", 128), ("script", 128), ("tag", 64)):
        out = subprocess.run([sys.executable, "-c", program, kind, str(mib)], capture_output=True, text=True, check=True, timeout=600).stdout.split()
        assert int(out[1]) < 200, (kind, out)
        assert int(out[0]) >= (mib * 90 if kind == "cards" else 1)


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    home = tmp_path_factory.mktemp("zips")
    (home / "sub").mkdir()
    with zipfile.ZipFile(home / "sub" / "b.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(500):
            z.writestr(f"messages/inbox/t/message_{k}.json", json.dumps({"k": k, "pad": "x" * 2000}))
        z.writestr("your_posts/posts/p.html", HOSTILE)
        z.writestr("m/a.jpg", b"\x00" * 10)
        z.writestr("empty/", b"")
    big = home / "big.zip"
    with big.open("wb") as f:
        f.truncate((2 << 30) + 5)  # sparse: the entries stand behind more than 2 GiB
    with zipfile.ZipFile(big, "a") as z:
        z.writestr("posts/posts.json", "[]")
        z.writestr("big/posts/x.html", "<h1>far</h1>")
    (home / "no.zip").write_bytes(b"not a ZIP archive")
    damaged = bytearray((home / "sub" / "b.ZIP").read_bytes())
    with zipfile.ZipFile(home / "sub" / "b.ZIP") as z:
        entry = z.getinfo("messages/inbox/t/message_3.json")
    damaged[entry.header_offset + 30 + len(entry.filename) + 10] ^= 255
    (home / "bad.zip").write_bytes(damaged)
    return str(home)


def test_parts_of_any_size_list_and_several_tasks_read_one(spark, parts):
    listing = zip_source.read_zips(spark, parts, entries_per_task=100).cache()
    names = {r["part_path"].rsplit("/", 1)[1]: r["n"] for r in listing.filter("error IS NULL").groupBy("part_path").agg(F.count("*").alias("n")).collect()}
    assert names == {"big.zip": 2, "b.ZIP": 502, "bad.zip": 502}
    assert [r["part_path"][-6:] for r in listing.filter("error IS NOT NULL").collect()] == ["no.zip"]
    one = zip_source.read_zips(spark, f"{parts}/sub", "texts", entries_per_task=100)
    assert one.rdd.getNumPartitions() == 6
    assert one.filter("format = 'json'").select(F.sum(F.get_json_object("text", "$.k").cast("int"))).first()[0] == sum(range(500))
    assert one.filter("format = 'json'").select(F.spark_partition_id()).distinct().count() == 6 - 1
    far = zip_source.read_zips(spark, f"{parts}/big.zip", "pages").filter("page IS NOT NULL").select("page.h1").collect()
    assert [r["h1"] for r in far] == ["far"]
    chunks = zip_source.read_zips(spark, f"{parts}/sub", "chunks", chunk_bytes=300).filter("path = 'messages/inbox/t/message_7.json'")
    assert chunks.agg(F.count("*"), F.sum(F.length("data")), F.max("size")).first() == (7, 2019, 2019)


def test_filters_reach_the_source(spark, parts):
    rows = zip_source.read_zips(spark, f"{parts}/sub", "texts").filter("section = 'posts' AND path LIKE 'your%' AND format IN ('html', 'json')")
    assert [r["path"] for r in rows.collect()] == ["your_posts/posts/p.html"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull", "") or "EqualTo(section,posts)" in plan


def test_broken_entries_and_limits_are_told(spark, parts):
    texts = zip_source.read_zips(spark, f"{parts}/bad.zip", "texts").cache()
    assert texts.filter("error IS NOT NULL").count() == 1 and texts.filter("text IS NOT NULL").count() == 500
    few = zip_source.read_zips(spark, f"{parts}/sub", "texts", most_json_bytes=2020)
    assert {r["error"] for r in few.filter("error IS NOT NULL").collect()} == {"over the limit of 2020 bytes"} and few.filter("text IS NOT NULL").count() == 101
    shallow = zip_source.read_zips(spark, parts, most_depth=0)
    assert "folder limit: depth of 0 near sub" in {r["error"] for r in shallow.filter("error IS NOT NULL").collect()}
    assert shallow.filter("part_path LIKE '%b.ZIP'").count() == 0
    one = zip_source.read_zips(spark, parts, most_files=1)
    assert [r["error"] for r in one.filter("part_path IS NULL").collect()] == ["folder limit: 1 ZIP files"]


DETECTION = {  # paths by part: format, sections, supported
    "json": (["profile_information/profile_information.json", "your_facebook_activity/posts/your_posts__1.json", "messages/inbox/chat/message_1.json"], "json", ["Profile", "Posts", "Messages"], True, 0.73),
    "v2": (["profile_v2/profile_v2.json", "messages/filtered_messages/chat/message-1.json"], "json", ["Profile", "Messages"], True, 0.67),
    "html": (["personal_information/profile_information/profile_information.html", "your_facebook_activity/posts/your_posts_1.html", "your_facebook_activity/messages/inbox/thread/message_1.html"], "html", ["Profile", "Posts", "Messages"], True, 0.73),
    "page": (["documents/readme.html"], "html", [], False, 0.05),
    "tax": (["documents/tax.pdf"], "unknown", [], False, 0.05),
    "media": (["your_facebook_activity/posts/media/a.JPG", "messages/inbox/t/photos/b.mp4"], "unknown", ["Posts", "Messages"], False, 0.05),
    "ads": (["ads_information/ads.json", "security/logins.json", "x\\ADS\\y.json"], "json", ["Ads", "Security"], True, 0.67),
}


def listing_of(spark, names):
    return spark.createDataFrame([(n, p) for n in names for p in DETECTION[n][0]], "part_path string, path string")


def test_detection_of_parts(spark):
    found = {r["part_path"]: r for r in archives.detect_parts(listing_of(spark, DETECTION)).collect()}
    assert {n: (r["format"], r["sections"], r["supported"], float(r["confidence"])) for n, r in found.items()} == {n: x[1:] for n, x in DETECTION.items()}
    assert {n for n, r in found.items() if r["media_only"]} == {"media"}
    assert any("HTML export detected" in w for w in found["html"]["detection_warnings"]) and found["page"]["detection_warnings"] == []
    assert found["ads"]["unsupported_sections"] == ["Ads", "Security"]


def test_detection_of_sets(spark):
    both = archives.detect(listing_of(spark, ["json", "html", "tax"])).first()
    assert (both["format"], both["supported"], both["sections"], float(both["confidence"])) == ("mixed", True, ["Profile", "Posts", "Messages"], 0.73)
    assert any("both JSON and HTML" in w for w in both["detection_warnings"])
    none = archives.detect(listing_of(spark, ["page", "tax"])).first()
    assert (none["supported"], none["format"], float(none["confidence"])) == (False, "html", 0.03)


def test_all_hints_of_a_path(spark):
    got = spark.createDataFrame([("a/messages/archived_threads/comments/x.json",), ("PROFILE_V2/x",), ("x.txt",), (None,)], "path string").select(archives.path_sections(F.col("path")).alias("s")).collect()
    assert [r["s"] for r in got][:3] == [["Messages", "Comments", "Ads"], ["Profile"], []]  # threads end in ads


def test_a_partition_with_more_entries_than_a_part_may_have(spark, tmp_path):
    files = spark.range(100_001).coalesce(1).select(F.concat(F.lit("posts/"), "id", F.lit(".json")).alias("path"), F.lit("[]").alias("text"))
    zip_source.write_parts(files, f"{tmp_path}/many")
    read = zip_source.read_zips(spark, f"{tmp_path}/many")
    assert read.filter("error IS NULL AND size = 2").agg(F.count_distinct("path")).first()[0] == read.count() == 100_001
    for n, parts in ((0, 0), (3, 1), (4, 2), (7, 3)):
        some = spark.range(n, numPartitions=1).select(F.concat(F.lit("posts/"), "id", F.lit(".json")).alias("path"), F.lit("[]").alias("text"))
        zip_source.write_parts(some if n else some.limit(0), f"{tmp_path}/{n}", entries=3)
        assert zip_source.read_zips(spark, f"{tmp_path}/{n}").count() == n and len(list((tmp_path / str(n)).glob("*.zip"))) == parts
