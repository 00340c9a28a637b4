"""Long texts of one language are identified and kept."""

import pytest

from equipoise.llm import langid


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang IS NOT NULL")


def test_long_texts_of_one_language(spark, labelled):
    profiles = langid.learn(labelled.filter(~langid.held_out()))
    tools = langid._compressors(profiles)
    rows = labelled.filter(langid.held_out()).select("lang", "text").collect()
    for lang in profiles.langs:
        text = "\n".join(r["text"] for r in rows if r["lang"] == lang and r["text"])
        for size in (1_000_000, 5_000_000):
            whole = (text * (size // len(text) + 1))[:size]
            got, score, rejected = langid.classify(whole, profiles.langs, tools, langid.MIN_MARGIN)
            assert (got, rejected) == (lang, False), (lang, size, score)


def test_segments_are_whole():
    for text in ("", "a", "é" * 30_001, "x€😀" * 20_000):
        parts = langid._segments(text.encode())
        assert b"".join(parts) == text.encode() and [p.decode() for p in parts]
        assert all(len(p) <= 1.5 * langid.SEGMENT + 4 for p in parts)
