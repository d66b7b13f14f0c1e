import base64
import json

from kbforge import sources


def test_markdown(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    body = "words of the page " * 10
    (root / "a.md").write_text(f"---\ntitle: \"The A\"\n# no: comment\nslug: /x/a\nkeywords: [k1, 'k2']\nempty:\n---\n{body}RIO-Live")
    (root / "sub" / "index.mdx").write_text(f"# Head One\n{body}")
    (root / "_skip.md").write_text(body)
    (root / "short.md").write_text("short")
    got = {r.title: r for r in sources.read_markdown_corpus(spark, str(root), "https://h/").collect()}
    assert got.keys() == {"The A", "Head One"} and got["The A"].url == "https://h/x/a" and got["The A"].keywords == ["k1", "k2"]
    assert got["The A"].text.endswith("RIO +LAN") and got["Head One"].url == "https://h/sub"


def test_text_folder_and_sitemap(spark, tmp_path):
    (tmp_path / "my_first-note.txt").write_text("long enough text")
    (tmp_path / "b.txt").write_text("x")
    assert [(r.title, r.tags) for r in sources.read_text_folder(spark, str(tmp_path), "c", ["t"]).collect()] == [("My First Note", ["t"])]
    xml = "<urlset><url><loc> https://h/a </loc><lastmod>2024</lastmod></url><url><loc>https://h/tags/x</loc></url><url><loc>https://h/b</loc></url></urlset>"
    assert sorted(map(tuple, sources.parse_sitemap(spark.createDataFrame([(xml,)], "value string")).collect())) == [("https://h/a", "2024"), ("https://h/b", None)]


def test_catalog_sheet_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Name,Manufacturer,Code Model,Device Type,Ports,Protocols,Supported Controls,Notes,Doc URL,Manufacturer URL\nFX6,Sony,,camera, USB | HDMI|,,,,,\n,Nobody,,,,,,,,\nX,Maker,C1,odd,,,,,,\n")
    good, bad = sources.read_catalog_csv(spark, str(tmp_path / "in.csv"), ["camera"])
    rows = {r.name: r for r in good.collect()}
    assert rows["FX6"].ports == ["USB", "HDMI"] and rows["FX6"].code_model is None and rows["X"].device_type is None and bad.count() == 1
    sources.write_catalog_csv(good, str(tmp_path / "out"))
    again, _ = sources.read_catalog_csv(spark, str(tmp_path / "out"), ["camera"])
    assert sorted(map(str, again.collect())) == sorted(map(str, good.collect()))


def test_mail_threads(spark, tmp_path):
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    head = lambda **h: [{"name": k, "value": v} for k, v in h.items()]
    thread = {"thread_id": "t", "messages": [
        {"payload": {"headers": head(Subject="Hi", From="a@b", Date="d1"), "body": {"data": enc("first ü?>")}}},
        {"payload": {"headers": head(From="c@d"), "parts": [{"mimeType": "multipart/x", "parts": [{"mimeType": "text/plain", "body": {"data": enc("inner")}}]}]}},
    ]}
    (tmp_path / "t.json").write_text(json.dumps(thread))
    r = sources.read_mail_threads(spark, str(tmp_path / "t.json")).first()
    assert r.text == "# Support Case: Hi\n\n**From:** a@b\n**Date:** d1\n\nfirst ü?>\n\n---\n\n**From:** c@d\n**Date:** \n\ninner" and r.message_count == 2


def test_fixes(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"exported_at": "x", "total": 1, "fixes": [{"id": "1", "original_text": "a", "confidence": 0.9}]}))
    fixes = sources.read_fixes(spark, str(tmp_path / "f.json"))
    assert fixes.first().status == "pending" and fixes.first().reasoning == ""
    sources.write_fixes(fixes.union(fixes).coalesce(1), str(tmp_path / "out"))
    assert sources.read_fixes(spark, str(tmp_path / "out"), lines=True).count() == 2
