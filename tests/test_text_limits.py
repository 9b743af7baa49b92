"""Limits in UTF-16 units, trimming of platform names, and the shared folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from faultsift import session
from faultsift.functions import frames, text


def utf16(s: str, n: int) -> str:
    return s.encode("utf-16-be")[:2 * n].decode("utf-16-be", errors="ignore")


def test_cuts_count_utf16_units_and_keep_pairs_whole(spark):
    samples = ["", "abc", "a" * 10, "😀" * 6, "a😀" * 5, "é" * 9 + "😀", None, "aaaaaaa😀x"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(text.truncate(F.col("s"), 8)).collect()]
    assert got == [None if s is None else utf16(s, 8) for s in samples]


def test_titles_of_two_hundred_units(spark):
    messages = ["m" * 195, "m" * 196, "😀" * 97, "😀" * 98, "m" + "😀" * 98]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    for m, r in zip(messages, df.select(text.title(F.lit("a.Bc"), F.col("m"))).collect(), strict=True):
        full = f"Bc: {m}"
        units = len(full.encode("utf-16-be")) // 2
        assert r[0] == (full if units <= 200 else utf16(full, 199) + "…")


def test_platform_names_lose_control_characters_at_both_ends(spark):
    df = spark.createDataFrame([("java\n",), ("\t Node \x01",), ("j ava",), (None,)], "p string")
    assert [r[0] for r in df.select(frames.declared_platform(F.col("p"))).collect()] == [
        "java", "javascript", "unknown", "unknown"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    def fake(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))
