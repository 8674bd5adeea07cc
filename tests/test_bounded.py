"""What must not grow on the driver or in one task: whole tables stay in tasks, quadratic steps are gone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.functions import algebra, emd
from axisframe.functions.mixed import mixed_model
from axisframe.operators import align, decomposition, mixed, statistics
from axisframe.plans.cube import Cube
from axisframe.plans.timecube import TimeCube
from axisframe.queries import QUERIES
from axisframe.sources import brainvision, edf
from axisframe.sources.files import join_files, read_lines
from axisframe.streaming import signal as streams

from .conftest import DATA


@pytest.mark.parametrize("name", ["rawbin_samples", "edf_annotations", "bdf_annotations", "brainvision_markers", "brainvision_floats", "align_events"])
def test_recordings_are_written_by_tasks(spark, monkeypatch, name):
    def collect(self):
        rows = real(self)
        assert len(rows) <= (100 if name == "align_events" else 8)  # lengths, pieces, numbers of markers; a run of pulses
        return rows

    real = DataFrame.collect
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toPandas", lambda self: pytest.fail("a table came to the driver"))
        m.setattr(DataFrame, "collect", collect)
        df = QUERIES[name](spark, DATA)
    assert df.count() > 8


def test_lines_of_ranges(tmp_path):
    path, text = str(tmp_path / "x"), b"head\na\n\nbcd\nlast"
    (tmp_path / "x").write_bytes(text)
    for step in range(1, 12):
        got = [x for s in range(5, len(text), step) for x in read_lines(path, s, min(s + step, len(text)), 5, len(text))]
        assert got == [b"a", b"", b"bcd", b"last"]


def test_markers_of_ranges(tmp_path):
    path = str(tmp_path / "m.vmrk")
    marks = ["Mk1=New Segment,,1,1,0,2024"] + [f"Mk{i}=Stimulus,S\\1{i},{i * 10},1,0" for i in range(2, 40)]
    (tmp_path / "m.vmrk").write_text("Title\n[Marker Infos]\n; a note\n" + "\n".join(marks) + "\n[Comment]\nMk99=Stimulus,no,1,1,0\n")
    h = brainvision.Header("", path, np.dtype("<i2"), 10.0, [], {})
    first, end, shift = brainvision.find_markers(path)
    got = [x for s in range(first, end, 17) for x in brainvision.read_markers(h, s, min(s + 17, end), first, end, shift)]
    assert got == [(0.0, "1", "New Segment")] + [((i * 10 - 1) / 10, "1", f"S,{i}") for i in range(2, 40)]


def test_annotations_of_ranges(spark, tmp_path):
    from axisframe.queries.recordings import PIECE, write_edf

    steps = spark.range(PIECE + 70).selectExpr("0 AS file", f"id div {PIECE} AS piece", "0 AS ch", "id AS smp", "id % 1000 AS step")
    notes = spark.range(30).selectExpr("id * 17.1 AS onset", "concat('n', id) AS text").selectExpr("cast(onset AS double) AS onset", "text")
    write_edf(path := str(tmp_path / "a.edf"), steps, {0: PIECE + 70}, notes, channels=1)
    h = edf.read_header(path)
    assert h.records == PIECE // 50 + 2
    assert [x for s in range(0, h.records, 7) for x in edf.read_annotations(h, s, min(s + 7, h.records))] == [(round(i * 17.1, 6), "0", f"n{i}") for i in range(30)]
    got = edf.read_samples(h, 0, 0, PIECE + 100)
    np.testing.assert_allclose(got, np.concatenate([np.arange(PIECE + 70) % 1000 * 0.1, np.zeros(30)]), atol=1e-9)


def test_join_files(tmp_path):
    for k in range(3):
        (tmp_path / str(k)).write_bytes(bytes([k]) * k)
    join_files(str(tmp_path / "sub" / "all"), b"h", [str(tmp_path / str(k)) for k in range(3)])
    assert (tmp_path / "sub" / "all").read_bytes() == b"h\x01\x02\x02"


def test_pulses_of_tables(spark):
    """As arrays give it, also where runs lie across stretches, and where nothing matches."""
    beh = np.cumsum(np.random.default_rng(0).uniform(500, 2000, 400))
    eeg = beh[7:] * 1.0001 / 1000 + 33
    tables = [spark.createDataFrame([(float(t),) for t in x], "t double") for x in (eeg, beh[7:])]
    assert align.times_to_offsets_tables(*tables, window=30) == pytest.approx(align.times_to_offsets_ends(eeg, beh[7:], window=30), rel=1e-12)
    ranked = spark.createDataFrame([(i, float(t * 1000)) for i, t in enumerate(eeg)], "i long, ms double")
    needles = [np.diff(eeg[a : a + 9] * 1000) for a in (0, 12, 13, 16, 384)] + [np.full(8, 7.0)]
    assert align._find_runs(needles, ranked, 1e-6, 16) == [0, 12, 13, 16, 384, -1]
    with pytest.raises(ValueError):
        align.times_to_offsets_tables(tables[0], spark.range(20).selectExpr("cast(id * 9 AS double) AS t"), threshold=0.1)


def test_runs_in_blocks():
    hay = np.arange(500.0) ** 2
    assert [align._first_window(hay, 3, lambda w, a=a: w[:, 0] == a * a, 64) for a in (0, 63, 64, 497, 498)] == [0, 63, 64, 497, -1]


def test_fdr_frames_grow(spark):
    """A frame up to a partition's end is summed up anew at each row: quadratic."""
    p = spark.range(1000).select((F.col("id") * 7919 % 1009 / 1010).alias("p"))
    frames = [x for x in statistics.fdr(p)._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ").split("windowspecdefinition(")[1:] if "__rank" in x.split(")")[0]]
    assert frames and not any("unboundedfollowing" in x.split("$())")[0] for x in frames)


def _plan(df, tmp_path):
    q = df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q._jsq.explainInternal(False)


def test_sessions_merge_before_they_move(spark, tmp_path):
    live = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/event[s].parquet").selectExpr("0 AS channel", "value", "cast(ts AS timestamp) AS ts")
    plan = _plan(streams.sessions(live, "5 minutes"), tmp_path)
    assert "MergingSessions" in plan[plan.rindex("Exchange") :]


def test_epochs_are_joined_by_bins(spark, tmp_path):
    live = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/event[s].parquet").selectExpr("event_id AS event", "'r' AS esrc", "0 AS channel", "value", "cast(ts AS timestamp) AS ts")
    df = streams.epochs(live.selectExpr("event", "esrc", "ts AS event_ts"), live.drop("event"), "5 minutes", "1 minute")
    keys = next(x for x in _plan(df, tmp_path).splitlines() if "StreamingSymmetricHashJoin" in x).split("]")[0]
    assert "event_bin" in keys


def test_permutations_of_large_groups(spark, monkeypatch):
    """Groups cut into bins of about 5 rows: as sorting each group whole gives it; rows times permutations aren't sorted in one order."""
    monkeypatch.setattr(statistics, "DEAL", 5)
    rows = [(i * 3 + 1, None if i % 4 == 3 else "ab"[i % 4 == 0]) for i in range(120)]
    df = statistics.permutations(spark.createDataFrame(rows, "i int, g string"), "i", "g", 6)
    got = {(r["perm"], r["i"]): r["source"] for r in df.collect()}
    assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    key = lambda i, k: i if not k else (i * 2654435761 + k * 40503 * (i % 97 + 1)) % (1 << 32)
    want = {}
    for g in ("a", "b", None):
        own = [i for i, x in rows if x == g]
        want |= {(k, i): s for k in range(7) for i, s in zip(own, sorted(own, key=lambda i: (key(i, k), i)), strict=True)}
    assert got == want


def test_bootstrap_ratios_by_sums(spark):
    """As drawing rows gives them, with missing values, units and features; rows aren't multiplied by the samples."""
    rng = np.random.default_rng(3)
    rows = [(u, f, None if (u + f) % 7 == 0 else float(rng.normal() + 1)) for u in range(9) for f in range(4) if (u * f) % 5 != 3] + [(0, 9, None), (1, 9, None)]
    df = spark.createDataFrame(rows, "u int, f int, value double")
    out = statistics.stability(df, "u", ["f"], "value", 60)
    assert "boot" not in out._jdf.queryExecution().analyzed().toString()
    draws = {}
    for r in statistics.bootstrap_counts(df, "u", 60).collect():
        draws.setdefault(r["boot"], {})[r["u"]] = r["weight"]
    for r in out.collect():
        own = [(u, v) for u, f, v in rows if f == r["f"]]
        means = []
        for w in draws.values():
            if any(v is not None and u in w for u, v in own):
                means.append(sum(w.get(u, 0) * (v or 0) for u, v in own) / sum(w.get(u, 0) for u, _ in own))
        given = [v for _, v in own if v is not None]
        assert r["ratio"] == (pytest.approx(np.mean(given) / np.std(means)) if given else None)


def test_kernels_get_one_run_at_a_time(spark):
    """Of a batch of runs one is in the works, and its labels are made one after the other."""
    cells = spark.range(4000).selectExpr("id % 4 AS a", "id div 4 AS t", "cast(id AS double) AS value")
    cube = TimeCube.of(Cube.from_positions(cells, ("a", "t")), "t", 1.0)

    def kernel(rows, t):
        assert rows.shape[0] == 1
        yield 1.0, rows
        yield 2.0, -rows

    assert cube.apply_chunked(kernel, 300, 10, "k").df.groupBy("k").agg(F.sum("value")).orderBy("k").collect() == [(1.0, 7998000.0), (2.0, -7998000.0)]
    assert cube.apply_named(lambda rows, t: ((k, (x, t)) for k, x in kernel(rows, t)), "k").df.groupBy("k").count().orderBy("k").collect() == [(1.0, 4000), (2.0, 4000)]


def test_ensembles_are_added_up_in_tasks(spark):
    cells = spark.range(128).selectExpr("0 AS a", "id AS t", "sin(id * 0.3) + cos(id) AS value")
    cube = TimeCube.of(Cube.from_positions(cells, ("a", "t")), "t", 1.0)
    got = cube.eemd(num_ensembles=13, num_sifts=3)
    x = np.array([r[0] for r in cells.orderBy("t").select("value").collect()])
    want = np.mean([emd.eemd_member(x, 0.2, 3, m) for m in range(13)], axis=0)
    have = np.zeros_like(want)
    for r in got.df.collect():
        have[r["mode_idx"], r["t_idx"]] = r["value"]
    np.testing.assert_allclose(have, want, atol=1e-12)
    assert "member__" not in got.df._jdf.queryExecution().analyzed().toString()  # samples aren't multiplied by members


def test_spline_of_many_knots():
    """A tridiagonal system solved without a step a knot, as dense algebra solves it."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 8, 33, 100):
        a, b, c, d = rng.uniform(-1, 1, n), rng.uniform(3, 4, n), rng.uniform(-1, 1, n), rng.normal(size=n)
        np.testing.assert_allclose(emd.tridiagonal(a, b, c, d), np.linalg.solve(np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1), d), rtol=1e-10, atol=1e-12)


def test_components_move_as_stretches(spark):
    """Cleaning gives what it gives on a whole series, over several stretches of samples."""
    n = 1 << 17
    x = np.random.default_rng(0).normal(size=n)
    x[700:720] += 60
    cells = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "component int, sample long, value double")
    cleaner = object.__new__(decomposition.ArtifactCleaner)
    cleaner.components, cleaner.samplerate, cleaner.chosen = cells, 200.0, [0]
    got = cleaner.clean().orderBy("sample").toPandas()["value"].to_numpy()
    assert "stretch" in cleaner.components._jdf.queryExecution().analyzed().toString()
    np.testing.assert_allclose(got, algebra.clean_component(x, 2.5, 20)[0], atol=1e-12)


def test_mixed_models_by_products(spark):
    """As fits of whole frames give it, also where keys have levels of their own; no task gets all rows of a key."""
    rng = np.random.default_rng(5)
    df = pd.DataFrame([(k, "abcde"[i % 5], "uvw"[i % (2 + k)], i % 7 < 3, float(rng.normal())) for k in range(2) for i in range(60)], columns=["k", "g", "f", "b", "x"])
    df["y"] = df["x"] * 2 + rng.normal(size=len(df)) + df["g"].map(ord) % 3
    for formula in ("y ~ x + f + (1 | g)", "y ~ x*f + b + (1 + x | g)", "y ~ x + (0 + b | g)"):
        fits = mixed.lmer(spark.createDataFrame(df), ["k"], "y", formula)
        assert "mapinpandas" in fits._jdf.queryExecution().analyzed().toString().lower()
        got = fits.toPandas()
        for k, part in df.groupby("k"):
            model, names = mixed_model(part, formula)
            want, have = model.fit(part["y"].to_numpy()), got[got["k"] == k]
            assert have["term"].tolist() == names
            np.testing.assert_allclose(have["beta"], want["beta"], rtol=1e-6, atol=1e-8)
            np.testing.assert_allclose(have["t"], want["t"], rtol=1e-5, atol=1e-6)
            np.testing.assert_allclose(have["loglik"], want["loglik"], rtol=1e-8)
