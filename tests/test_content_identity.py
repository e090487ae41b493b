"""Identity of documents with images: by the bytes of the images, not by their paths."""

from __future__ import annotations

import pytest

from quorumlake.functions import content
from quorumlake.sources import datasets


def test_identity_follows_the_bytes(spark, tmp_path):
    for name, data in (("a.png", b"one"), ("copy.png", b"one"), ("b.png", b"two")):
        (tmp_path / name).write_bytes(data)
    files = datasets.images(spark, str(tmp_path))
    path = {r.path.rsplit("/", 1)[1]: r.path for r in files.collect()}
    text, image = lambda t: (t, None), lambda n: (None, path.get(n, n))
    rows = [
        (0, [text("see "), image("a.png"), text("there")]), (1, [text("s"), text("ee "), image("copy.png"), text(""), text("there")]), (2, [text("see "), image("b.png"), text("there")]),
        (3, [image("a.png"), text("see there")]), (4, [text("see there")]), (5, [text("see "), image("a.png"), image("a.png"), text("there")]), (6, []),
    ]
    frame = spark.createDataFrame(rows, f"id int, parts array<{content.PART}>")
    got = {r.id: r.identity for r in content.content_identities(frame, files, ["id"]).collect()}
    assert got[0] == got[1] and len(set(got.values())) == 6
    with pytest.raises(Exception, match="no file of the image gone.png"):
        content.content_identities(spark.createDataFrame([(0, [image("gone.png")])], frame.schema), files, ["id"]).collect()
