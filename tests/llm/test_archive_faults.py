"""Archives with faults, and files bounded by bytes."""

from itertools import islice

import numpy as np
import pytest

from courtflux.llm import common, warc


def test_faults_are_left_out_and_listed(spark):
    good = [warc.arc_record(1, f"http://h/{i}", warc.http_response(i, b"payload %d " % i * 20), "n", 0) for i in range(4)]
    bad_fields = b"http://h/x 0.0.0.0 20240101000000 text/html\n\nabc\n"
    bad_length = b"http://h/x 0.0.0.0 20240101000000 text/html many\nabc\n"
    too_long = b"http://h/x 0.0.0.0 20240101000000 text/html 999\nabc\n"
    files = [
        [warc.version_block(1, "a"), good[0], bad_fields, good[1], bad_length + good[3], too_long, good[2]],
        [good[0]],  # no version block
    ]
    path = common.shared_dir(spark)
    for i, parts in enumerate(files):
        blob = bytearray(b"".join(map(warc.member, parts)))
        spark.createDataFrame([(blob,)], "value binary").coalesce(1).transform(lambda df, to=f"{path}/{i}": warc.write_members(df, to) or df)
    broken = bytearray(warc.member(warc.version_block(1, "b")) + warc.member(good[3])[:-30])
    warc.write_members(spark.createDataFrame([(broken,)], "value binary").coalesce(1), f"{path}/2")
    files = f"{path}/*"
    assert sorted(r.page_id for r in warc.arc_captures(spark, files, False).collect()) == [0, 1, 2]
    reasons = [(r.member, bool(r.reason)) for r in warc.rejected(spark, files).collect()]
    assert sorted(reasons) == [(0, True), (1, True), (2, True), (4, True), (5, True)]
    out = common.shared_dir(spark)
    warc.convert(spark, files, out)
    assert sorted(r.page_id for r in warc.read_warc(spark, out).collect()) == [0, 1, 2]


def test_files_are_bounded_by_bytes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"http://h/{i}", rng.bytes(int(rng.integers(0, 2500))).hex()) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = common.shared_dir(spark)
    warc.write_arc(pages, path, (3000, 4))
    sizes = [len(r.content) for r in warc.read_files(spark, path).collect()]
    assert len(sizes) > 4 and max(sizes) < 4 * (3000 + 5200)
    assert warc.rejected(spark, path).count() == 0
    got = {r.page_id: r.size for r in warc.arc_captures(spark, path, False).collect()}
    assert got == {i: len(h) for i, _, h in rows}
    assert {r.page_id for r in warc.archive(pages, limits=(3000, 4)).collect()} == set(got)


@pytest.mark.parametrize("length", ["-46", "+5", " 5", "5_0", "٥", "", "1" * 5000])
def test_lengths_are_plain_digits(length):
    """A negative length would lead back to its own header line, for ever."""
    head = "http://h/x 0.0.0.0 20240101000000 text/html "
    with pytest.raises(ValueError):
        list(islice(warc.parse_arc((head + length + "\n").encode() + b"x" * 50, warc.V1), 1000))
    if " " in length:  # the line's last word is a length there
        return
    with pytest.raises(ValueError):
        list(islice(warc.parse_arc(f"filedesc://a 0.0.0.0 20240101000000 text/plain {length}\n1 0 x\n".encode()), 1000))


def test_a_negative_length_is_rejected(spark):
    line = b"http://h/x 0.0.0.0 20240101000000 text/html -46\n"
    good = warc.arc_record(1, "http://h/1", warc.http_response(1, b"payload" * 20), "n", 0)
    path = common.shared_dir(spark)
    blob = bytearray(b"".join(map(warc.member, [warc.version_block(1, "a"), line, good])))
    warc.write_members(spark.createDataFrame([(blob,)], "value binary").coalesce(1), path)
    assert [r.page_id for r in warc.arc_captures(spark, path, False).collect()] == [1]
    assert [r.member for r in warc.rejected(spark, path).collect()] == [1]
