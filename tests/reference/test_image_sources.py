"""Image references of every kind, and what is said about those that lead nowhere."""

import base64
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from proofmill.operators import image_sources
from proofmill.operators.keyed import KeyedTable
from proofmill.sources import sinks

PNG = bytes.fromhex("89504E470D0A1A0A") + b"pixels" + bytes.fromhex("49454E44AE426082")
JPEG = bytes.fromhex("FFD8FFE0") + b"pixels" + bytes.fromhex("FFD9")
PAGES = {
    "/a.png": ("image/png", PNG), "/private": ("application/xml", b"<Error><Code>AccessDenied</Code>"), "/login": ("text/html", b"<p>log in"), "/xml": ("text/plain", b"<?xml version='1.0'?>"),
    "/odd": ("image/png", b"RIFX"), "/empty": ("image/png", b""), "/cut.png": ("image/png", PNG[:-4]),
}


def test_every_case(spark, tmp_path):
    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            kind, body = PAGES.get(self.path, ("", None))
            self.send_response(404 if body is None else 200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *a):
            pass

    asked: list[str] = []
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "files" / "deep").mkdir(parents=True)
    (tmp_path / "files" / "deep" / "b.jpg").write_bytes(JPEG)
    (tmp_path / "files" / "none.png").write_bytes(b"")
    store = str(tmp_path / "blobs")
    (sha,) = [r["sha256"] for r in sinks.put_blobs(spark.createDataFrame([(PNG,)], "content binary"), store).collect()]
    gone, lost = "a" * 64, "b" * 64
    index = spark.createDataFrame([(gone, f"{at}/a.png"), (lost, "")], "sha256 string, source_url string")
    uri = lambda b: "data:image/png;base64," + base64.b64encode(b).decode()
    cases = [
        (None, ("none", None, "no image source provided")), ("", ("none", None, "no image source provided")),
        (f"blob:{sha}", ("blob", PNG, "")), (f"blob:{gone}", ("blob", PNG, "")), (f"blob:{lost}", ("blob", None, "prefetched image no longer in blob store")),
        (uri(JPEG), ("data-uri", JPEG, "")), (f"  {uri(PNG)} ", ("data-uri", PNG, "")), (uri(b"text"), ("data-uri", b"text", "unreadable/corrupt image (UnidentifiedImageError)")),
        ("data:image/png;base64,", ("data-uri", b"", "empty image payload from data-uri")), ("data:nothing", ("data-uri", None, "could not read image source (IndexError: list index out of range)")),
        ("data:x,abc", ("data-uri", None, "could not read image source (Error: Incorrect padding)")),
        (f"{at}/a.png", ("url", PNG, "")), (f"{at}/missing", ("url", None, "could not download image (HTTPError)")), ("HTTP://127.0.0.1:1/x", ("url", None, "could not download image (ConnectionError)")),
        (f"{at}/private", ("url", PAGES["/private"][1], "image URL is private / access denied — the link needs a valid signature or permission")),
        (f"{at}/login", ("url", PAGES["/login"][1], "image URL returned a web page, not an image (likely a private/expired/login link)")),
        (f"{at}/xml", ("url", PAGES["/xml"][1], "image URL returned an error response, not an image (likely a private/expired link)")),
        (f"{at}/odd", ("url", b"RIFX", "unreadable/corrupt image (UnidentifiedImageError)")), (f"{at}/empty", ("url", b"", "empty image payload from url")),
        (f"{at}/cut.png", ("url", PNG[:-4], "unreadable/corrupt image (OSError)")),
        ("deep/b.jpg", ("file", JPEG, "")), (f"{tmp_path}/files/deep/b.jpg", ("file", JPEG, "")), ("none.png", ("file", None, "image file not found (none.png)")), ("x.png", ("file", None, "image file not found (x.png)")),
    ]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate([*cases, cases[11]])], "id int, source string")
    got = image_sources.load_images(rows, store=store, index=index, files=str(tmp_path / "files")).collect()
    server.shutdown()
    want = [w for _, w in cases] + [cases[11][1]]
    for r in sorted(got, key=lambda r: r["id"]):
        assert (r["origin"], None if r["content"] is None else bytes(r["content"]), r["error"]) == want[r["id"]], (r["id"], r["source"])
    assert len(got) == len(want) and asked.count("/a.png") == 1


def test_blobs_are_touched(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, datetime(2024, 1, 1)), ("b", 2, datetime(2024, 1, 2))], "sha256 string, bytes long, last_used timestamp")
    index = KeyedTable(spark, str(tmp_path / "index"), ["sha256"], rows.schema, {"last_used": "max"})
    index.write(rows, "first")
    image_sources.touched(index, spark.createDataFrame([("b",), ("b",), ("z",)], "sha256 string"), F.lit(datetime(2024, 5, 5)), "second")
    assert sorted(map(tuple, index.read().collect())) == [("a", 1, datetime(2024, 1, 1)), ("b", 2, datetime(2024, 5, 5))]
