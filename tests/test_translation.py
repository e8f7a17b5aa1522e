"""The translation stage with the offline provider and with providers that go wrong."""

import pytest

from foliant.operators import translation
from foliant.operators.translation import CallingProvider, OfflineProvider


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([("b", 0, ["first text", "", "second"]), ("b", 1, ["third"])], "book string, ordinal long, blocks array<string>")


def rows(df):
    return sorted((r.ordinal, r.block_idx, r.target, r.reason) for r in df.collect())


def test_offline(chunks):
    got = rows(translation.translate(chunks, ["book", "ordinal"], "blocks", OfflineProvider({"text": "szöveg"})))
    assert [g[:2] for g in got] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert "FIRST SZÖVEG" in got[0][2] and got[3][2].endswith("THIRD")
    assert all(g[3] is None for g in got)


def test_lost_marks_fall_back_to_blocks(chunks):
    def call(texts):  # loses all marks but the first
        return [t if "【" not in t else "【0】\nok" for t in texts]

    got = rows(translation.translate(chunks, ["book", "ordinal"], "blocks", CallingProvider(call, 2)))
    assert [(g[0], g[1], g[2]) for g in got if g[1] != 1] == [(0, 0, "ok"), (0, 2, "second"), (1, 0, "ok")]


def test_guard_retries_once_and_then_tells(chunks):
    def call(texts):
        return [t.replace("first text", "I can't generate that") if "【" in t else "jó" for t in texts]

    got = rows(translation.translate(chunks, ["book", "ordinal"], "blocks", CallingProvider(call, 2)))
    assert got[0][2:] == ("jó", None)
    bad = rows(translation.translate(chunks, ["book", "ordinal"], "blocks", CallingProvider(lambda texts: ["as an AI" for _ in texts], 2)))
    assert {g[3] for g in bad if g[1] != 1} == {"refusal"}


def test_delays():
    assert translation.retry_delays() == [1, 2, 4, 8]
    assert max(translation.retry_delays(9)) == 30
