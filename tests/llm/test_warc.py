import hashlib
import io
import random

import zstandard

from slatewise.llm.warc import BundleWriter, archive_round_trip, fetch_records, file_at, parse_records, read_archives, record_name, resolve, seek_table, write_archives, write_record
from tests.llm.helpers import rows

SCHEMA = "page_id bigint, url string, html string, digest string, payload string, path string"


def pages(spark, htmls, ids=None):
    ids = list(range(len(htmls))) if ids is None else ids
    return spark.createDataFrame([(i, f"http://x/{i}\r\n", h, "d", "p", "q") for i, h in zip(ids, htmls)], SCHEMA).repartition(3)


def plain(htmls, ids):
    first = {}
    for i, h in zip(ids, htmls):
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, h in zip(ids, htmls):
        data = (h or "").encode()
        target = first.get(data)
        refers = target if target is not None and (i is None or i > target) else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    long = "é\r\n\r\nWARC/1.1\r\n" * 20_000
    htmls = [None, "", "short", "short", "a" * 100, "a" * 100, "a" * 99, "a" * 99, long, long, "é" * 50, "é" * 50, *("".join(rng.choice("ab\r\n") for _ in range(200)) for _ in range(50))]
    ids = [0, 1, 2, 3, 7, 5, 8, 9, None, 11, None, None, *range(20, 70)]
    assert rows(archive_round_trip(pages(spark, htmls, ids))) == plain(htmls, ids)
    assert archive_round_trip(pages(spark, [])).count() == 0
    assert rows(archive_round_trip(pages(spark, ["b" * 200] * 3, [4, 4, 6]))) == plain(["b" * 200] * 3, [4, 4, 6])


def test_index_reaches_single_records(spark, tmp_path):
    htmls = [f"{i} " * 300 for i in range(200)]
    index = write_archives(resolve(pages(spark, htmls)), str(tmp_path / "w"), frame_bytes=1000, bundle_bytes=1500)
    assert index.select("path").distinct().count() > 3 and index.agg({"frame": "max"}).first()[0] > 3
    got = rows(fetch_records(index, spark.createDataFrame([(3,), (150,), (150,), (999,)], "page_id bigint")))
    assert got == [r for r in plain(htmls, list(range(200))) if r[0] in (3, 150)]
    assert rows(read_archives(index)) == plain(htmls, list(range(200)))


def test_bundle_format(tmp_path):
    path = str(tmp_path / "a" / "b.warc.zst")
    writer = BundleWriter(path, 1000)
    records = [write_record(i, None, b"x" * 300 * i, hashlib.sha256(b"x" * 300 * i).hexdigest(), 300 * i, None) for i in range(9)]
    for i, record in enumerate(records):
        writer.add(i, record_name(i), record)
    index = writer.close()
    data = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)  # any reader takes it
    store, name = file_at(path)
    with store.open_input_file(name) as file:
        table = seek_table(file)
        assert len(table) == index[-1][3] + 1 > 1
        for page, _, _, frame, offset, size, at, length in index:
            assert table[frame][:2] == (offset, size)
            plain_frame = zstandard.ZstdDecompressor().decompress(data[offset : offset + size])
            assert plain_frame[at : at + length] == records[page] and len(list(parse_records(plain_frame))) >= 1
