from pathlib import Path

from hopspark.sources import acquire


def test_documents_are_fetched_once_and_failures_left_for_later(spark, tmp_path):
    place = tmp_path / "files"
    place.mkdir()
    for k in range(4):
        (place / f"{k}.html").write_bytes(b"\xff page %d" % k)
    (place / "empty.html").write_bytes(b"")
    rows = [(str(k), f"file://{place}/{k}.html") for k in range(5)] + [("e", f"file://{place}/empty.html"), (None, "x"), ("n", None)]
    items = spark.createDataFrame(rows, "id string, url string")
    kept = str(tmp_path / "kept")
    how = {"pause": 0.0, "first_wait": 0.0, "attempts": 2}
    first = {r.id: bytes(r.content) for r in acquire.download(items, kept, **how).collect()}
    assert first == {str(k): b"\xff page %d" % k for k in range(4)}
    # what is there isn't fetched again, what failed or was empty is
    for k in range(5):
        (place / f"{k}.html").write_bytes(b"new")
    (place / "empty.html").write_bytes(b"now")
    second = {r.id: bytes(r.content) for r in acquire.download(items, kept, **how).collect()}
    assert second == first | {"4": b"new", "e": b"now"}


def test_failed_fetches_are_tried_again(spark, tmp_path):
    def flaky(url):
        marks = list(Path(tmp_path).glob("mark*"))
        (Path(tmp_path) / f"mark{len(marks)}").touch()
        if len(marks) < 2:
            raise TimeoutError
        return b"late"

    items = spark.createDataFrame([("a", "u")], "id string, url string")
    got = acquire.download(items, str(tmp_path / "kept"), flaky, pause=0.0, first_wait=0.0).collect()
    assert [bytes(r.content) for r in got] == [b"late"] and len(list(Path(tmp_path).glob("mark*"))) == 3
