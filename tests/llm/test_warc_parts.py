"""A response's two forms, made in one pass."""

from copperleaf.llm import warc


def test_a_revisit_in_parts_is_the_revisit():
    for block in (b"HTTP/1.1 200 OK\r\nWARC-Refers-To: ?\r\n\r\n<p>x</p>\r\nWARC-Refers-To: ?", b"HTTP/1.1 200 OK\r\n\r\n"):
        head, payload = warc.split_http(block)
        rec = {"kind": "response", "head": head, "payload": payload, "record_id": "<urn:uuid:1>", "date": "20240101", "url": "http://a/?x=WARC-Refers-To: ?", "ip": "1.1.1.1", "digest": "D", "mime": "text/html", "page_id": 7}
        before, after = warc.revisit_parts(rec)
        assert before + b"<urn:uuid:2>" + after == warc.warc_record(rec, "<urn:uuid:2>")


def test_what_is_handed_on_at_once_is_small():
    assert warc.BATCH_BYTES <= 2 << 20
