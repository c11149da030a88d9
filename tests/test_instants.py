import random
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest

from tallywise.operators.instants import AGAINST, NONE, _step, mixture, normalise

CLIENTS = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("no", None, "dmy"), ("off", "+05:45", "dmy"), ("bad", "Mars/Base", "dmy"), ("free", "UTC", None)]


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("ny", "2025-09-02T08:16:37.209Z", us(2025, 9, 2, 8, 16, 37, micro=209000)),
    ("ny", ' "2025-09-02 08:16:37.123456789"\r', us(2025, 9, 2, 12, 16, 37, micro=123456)),
    ("be", "2025-09-02t08:16z", us(2025, 9, 2, 8, 16)),
    ("be", "1756754515620", us(2025, 9, 1, 19, 21, 55, micro=620000)),
    ("be", "1756754515.5", us(2025, 9, 1, 19, 21, 55, micro=500000)),
    ("be", "1756754515620123", us(2025, 9, 1, 19, 21, 55, micro=620123)),
    ("be", "1756754515620123999", us(2025, 9, 1, 19, 21, 55, micro=620123)),
    ("be", "999999999", None),
    ("ny", "01/09/2025 13:22:52", us(2025, 1, 9, 18, 22, 52)),
    ("be", "01/09/2025 13:22:52", us(2025, 9, 1, 11, 22, 52)),
    ("be", "2025/09/01 13:22:52", us(2025, 9, 1, 11, 22, 52)),
    ("ny", "10.11.2025 12:00", us(2025, 11, 10, 17)),
    ("ny", "25.13.2025 12:00", None),
    ("ny", "13/25/2025 12:00", None),
    ("no", "13. März 2026, 11:44", us(2026, 3, 13, 11, 44)),
    ("ny", "Sep 10, 2025 12:08:13 AM", us(2025, 9, 10, 4, 8, 13)),
    ("ny", "Tue, 24 Mar 2026 14:36:00 -0400", us(2026, 3, 24, 18, 36)),
    ("be", "Wed Sep  3 15:58:30 CEST 2025", us(2025, 9, 3, 13, 58, 30)),
    ("ny", "2025-11-02 01:30:00 EST", us(2025, 11, 2, 6, 30)),
    ("ny", "2025-11-02 01:30:00", None),
    ("ny", "2026-03-08 02:30:00", None),
    ("ny", "2025-11-02T01:30:00-04:00[America/New_York]", us(2025, 11, 2, 5, 30)),
    ("off", "2025-09-02 05:45:00", us(2025, 9, 2)),
    ("bad", "2025-09-02 05:45:00", None),
    ("gone", "20250902 054500", us(2025, 9, 2, 5, 45)),
    (None, "20250902T054500Z", us(2025, 9, 2, 5, 45)),
    ("ny", "2025-306T08:14:55Z", us(2025, 11, 2, 8, 14, 55)),
    ("ny", "2025-366T08:14:55Z", None),
    ("ny", "2026-02-29T08:14:55Z", None),
    ("ny", "2025-01-01T24:00:00Z", None),
    ("ny", "2025-09-02 08:00:00 XYZ", None),
    *[("ny", x, None) for x in ("2025-09-02", "10:30:00", "", "  ", "TBD", "yesterday 14:05", "0000-00-00 00:00:00", None, "9" * 3000)],
]


def frames(spark, cases):
    df = spark.createDataFrame([(i, c, t, None, "z") for i, (c, t, *_) in enumerate(cases)], "row_id long, client string, t string, u string, status string")
    return df, spark.createDataFrame(CLIENTS, "client string, zone string, ord string")


def run(spark, df, clients):
    return normalise(df, "row_id", ["t", "u"], "client", clients, "client", "zone", "ord")


def test_forms(spark):
    got = {r["row_id"]: r["instant_us"] for r in run(spark, *frames(spark, CASES)).where("status = 'instant'").collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(CASES) if x is not None}


def test_states(spark):
    cases = [("ny", "2025-11-02 01:30:00"), ("ny", "2026-03-08 02:30:00"), ("bad", "2025-09-02 05:45:00"), ("ny", "2025-02-30 05:45:00"), ("lost", "05/06/2025 10:00")]
    got = [r["status"] for r in run(spark, *frames(spark, cases)).orderBy("row_id").collect()]
    assert got == ["repeated", "skipped", "unknown_zone", "impossible", "ambiguous"]


def test_mixture_decides(spark):
    cases = [("free", f"{d}/05/2025 10:00") for d in range(13, 29)] + [("free", "03/04/2025 10:00"), ("lost", "04/25/2025 10:00")]
    got = run(spark, *frames(spark, cases)).orderBy("row_id").collect()
    assert {r["format"] for r in got[:17]} == {"dmy"} and got[16]["instant_us"] == us(2025, 4, 3, 10) and got[16]["posterior"] > 0.95 and got[17]["format"] == "mdy"


def test_mixture_numbers():
    def out(*rows):
        return mixture(pd.DataFrame({"source": ["s"] * len(rows), "signature": [r[0] for r in rows], "n": [r[1] for r in rows]}))

    a = out(("mdy,dmy", 10), ("mdy", 90), ("", 3))
    assert list(a["format"]) == ["mdy", "mdy", None] and a["posterior"][0] > 0.98 and a["converged"].all()
    # Few clear values decide for many unclear ones; none leaves them open, and one isn't enough.
    for n in (20, 10**3, 10**7):
        a = out(("mdy,dmy", n), ("dmy", 3))
        assert a["format"][0] == "dmy" and a["posterior"][0] == pytest.approx(3.1 / 3.2, abs=1e-4) and a["converged"].all()
    assert out(("mdy,dmy", 20), ("dmy", 1))["posterior"][0] < 0.95 and out(("mdy,dmy", 50))["posterior"][0] == pytest.approx(0.5, abs=1e-4)
    # The registered order outweighs a source's other values; what only it speaks against is no time.
    a = out(("mdy,dmy!", 5), ("dmy!", 50), ("ymd", 9))
    assert list(a["format"]) == ["mdy", None, "ymd"] and a["posterior"][0] > 0.99
    a = out(("ymd first,ymd second", 5), ("ymd", 9))
    assert a["posterior"][0] == pytest.approx(0.5, abs=1e-4)
    assert not mixture(pd.DataFrame({"source": ["s"], "signature": ["a,b"], "n": [5]}), steps=0)["converged"].any()


def test_mixture_without_extrapolation():
    """The same fixed point as plain steps."""
    rnd = random.Random(3)
    for _ in range(20):
        c = pd.DataFrame([("s", x, rnd.randint(1, 60)) for x in ("mdy,dmy", "mdy", "dmy", "ymd", "mdy,dmy!", "ymd first,ymd second")], columns=["source", "signature", "n"])
        like = np.array([[1, 1, 0, 0, 0], [0, 1, 0, 0, 0], [1, 0, 0, 0, 0], [0, 0, 1, 0, 0], [AGAINST, 1, 0, 0, 0], [0, 0, 0, 1, 1]], float)
        like, pi = np.c_[like, np.full(6, NONE)], np.full(6, 1 / 6)
        for _ in range(20_000):
            pi = _step(pi, like, c["n"].to_numpy(float))
        r = like * pi
        assert mixture(c)["posterior"].to_numpy() == pytest.approx((r / r.sum(1, keepdims=True)).max(1), abs=1e-4)


def test_empty(spark):
    df, clients = frames(spark, CASES[:1])
    assert run(spark, df.where("false"), clients).count() == 0 and run(spark, df, clients.where("false")).count() == 1
