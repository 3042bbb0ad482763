"""Carved media of any binary column."""

from courtflux.llm import media


def test_carve_any_column(spark):
    wav, bmp, au = (w(media.padded(b"x" * 30)) for _, w in media.WRITERS)
    blobs = [wav, b"prefix" + bmp, wav[:-1], b"", None, b"no media", wav + b"--" + au + bmp]
    rows = [(i, b, "image/gif" if i != 5 else None) for i, b in enumerate(blobs)]
    df = spark.createDataFrame(rows, "key long, blob binary, said string").repartition(2)
    got = {r.key: r for r in media.carve(df, "blob", "said").collect()}
    assert [got[i].type for i in range(7)] == ["audio/wav", "image/gif", "image/gif", "image/gif", None, "application/octet-stream", "audio/wav"]
    assert [(c.kind, c.start, c.end, bytes(c.bytes)) for c in got[1].carved] == [("image/bmp", 6, 6 + len(bmp), bmp)]
    at = len(wav) + 2
    assert [(c.kind, c.start, c.end, bytes(c.bytes)) for c in got[6].carved] == [("audio/basic", at, at + len(au), au), ("image/bmp", at + len(au), at + len(au) + len(bmp), bmp)]
    assert all(got[i].carved == [] for i in (0, 2, 3, 4, 5)) and bytes(got[0].payload) == media.padded(b"x" * 30)
    assert media.carve(df, "blob", None).where("key = 2").first().type == "application/octet-stream"


def test_features_of_unconfirmed(spark):
    wav = media.to_wav(media.padded(b"y"))
    rows = [(1, 1, "audio/wav", wav[:-2]), (2, 0, None, None), (3, 1, "image/png", b"ab" + wav), (4, 0, None, b"")]
    got = {r.doc_id: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary")).collect()}
    assert got[1].payload_bytes == len(wav) - 2 and got[1].feature.startswith("audio/wav;as declared;embedded=0;")
    assert got[2].feature is None and got[2].payload_sha256 is None
    assert got[3].feature.startswith("image/png;as declared;embedded=1;") and got[4].feature == "application/octet-stream;declared None;embedded=0;mean=0.0000"
