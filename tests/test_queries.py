"""Every registered raster and catalog query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sarspark import fixtures as fx
from sarspark.operators import sar
from sarspark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    order = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == order
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in found.fetchall())
    assert got == want and got


def images(spark, data, table, *names):
    """Arrays of a fixture by its indices."""
    rows = getattr(fx, table)(spark, data).toPandas()
    keys = [k for k in ("t", "r", "c") if k in rows]
    out = np.zeros([int(rows[k].max()) + 1 for k in keys], complex)
    out[tuple(rows[k] for k in keys)] = rows[names[0]] + 1j * rows[names[1]]
    return out


def test_goldstein_against_numpy(spark, data):
    p = sar.interferogram(fx.slc(spark, data, 0), fx.slc(spark, data, 1)).toPandas()
    z = np.zeros((int(p.r.max()) + 1, 32), complex)
    z[p.r, p.c] = p.re + 1j * p.im
    window = np.hanning(17)[:-1]
    total, weight = np.zeros(z.shape, complex), np.zeros(z.shape)
    for r in range(0, z.shape[0], 12):
        for c in range(0, 32, 12):
            cut = np.zeros((16, 16), complex)
            part = z[r : r + 16, c : c + 16]
            cut[: part.shape[0], : part.shape[1]] = part
            f = np.fft.fft2(cut)
            a = np.pad(np.abs(f), 1, mode="symmetric")
            w = np.sqrt(np.lib.stride_tricks.sliding_window_view(a, (3, 3)).mean((2, 3)))
            here = np.outer(window, window)[: part.shape[0], : part.shape[1]]
            total[r : r + 16, c : c + 16] += np.fft.ifft2(f * w)[: part.shape[0], : part.shape[1]] * here
            weight[r : r + 16, c : c + 16] += here
    want = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)
    got = QUERIES["goldstein"](spark, data).collect()
    assert len(got) == z.size and all(abs(complex(x.re, x.im) - want[x.r, x.c]) < 2e-6 for x in got)


@pytest.mark.parametrize(("lines", "padded"), [(1000, 1000), (513, 525)])
def test_antialiased_2d_against_one_transform(spark, tmp_path, lines, padded):
    """The SQL is written for images of 250 lines; taller ones are held against numpy."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(f"vec_id < {2 * lines}")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    ups = []
    for k in (0, 1):
        x = fx.slc(spark, str(tmp_path), k).toPandas()
        z = np.zeros((lines, 32), complex)
        z[x.r, x.c] = x.re + 1j * x.im
        wide, first = np.zeros((2 * padded, 64), complex), padded - padded // 2
        wide[first : first + padded, 16:48] = np.fft.fftshift(np.fft.fft2(z, (padded, 32)))
        ups.append(4 * np.fft.ifft2(np.fft.ifftshift(wide))[: 2 * lines])
    want = (ups[0] * ups[1].conj()).reshape(lines, 2, 32, 2).mean((1, 3))
    got = QUERIES["interferogram_aa_2d"](spark, str(tmp_path)).collect()
    assert len({(x.r, x.c) for x in got}) == len(got) == want.size and all(abs(complex(x.re, x.im) - want[x.r, x.c]) < 1e-6 for x in got)


def slow_phases(samples):
    """EMI of (images, pixels) step by step."""
    c = np.array([[(a * b.conj()).sum() / math.sqrt((np.abs(a) ** 2).sum() * (np.abs(b) ** 2).sum()) for b in samples] for a in samples])
    w = np.linalg.inv(np.abs(c) + 1e-6 * np.eye(len(c))) * c
    values, vectors = np.linalg.eigh((w + w.conj().T) / 2)
    v = vectors[:, np.argmin(np.abs(values))]
    return c, np.angle(v * v[0].conj())


def test_emi_against_numpy(spark, data):
    z = images(spark, data, "stack", "re", "im")
    want = slow_phases(z.reshape(len(z), -1))[1]
    got = {x.t: x.phase for x in QUERIES["emi"](spark, data).collect()}
    assert sorted(got) == list(range(5)) and all(abs(np.angle(np.exp(1j * (got[t] - want[t])))) < 2e-5 for t in got)


def test_phase_link_against_a_walk(spark, data):
    """Every hundredth pixel by a walk through its window."""
    z = images(spark, data, "stack", "re", "im")
    n, h, w = z.shape
    power = (np.abs(z) ** 2).sum(0) / (2 * n)
    got = {(x.t, x.r, x.c): x for x in QUERIES["phase_link"](spark, data).collect()}
    assert len(got) == z.size
    for k in range(0, h * w, 100):
        i, j = divmod(k, w)
        found, todo = {(i, j)}, [(i, j)]
        while todo:
            y, x = todo.pop()
            for a in range(max(y - 1, i - 11, 0), min(y + 2, i + 12, h)):
                for b in range(max(x - 1, j - 11, 0), min(x + 2, j + 12, w)):
                    p, q = power[a, b], power[i, j]
                    if (a, b) not in found and p > 0 and q > 0 and 2 * math.log((p + q) / 2) - math.log(p) - math.log(q) < 3.841458820694124 / (2 * n):
                        found.add((a, b))
                        todo.append((a, b))
        linked, coh = z[:, i, j], np.zeros(n)
        if len(found) > 1:
            samples = np.array([z[:, a, b] for a, b in found]).T
            c, phases = slow_phases(samples)
            linked, coh = np.abs(samples).mean(1) * np.exp(1j * phases), np.abs(c[0])
        for t in range(n):
            x = got[t, i, j]
            assert abs(complex(x.re, x.im) - linked[t]) < 2e-4 and abs(x.coh - coh[t]) < 1e-4


def test_every_query_has_sql_or_a_check():
    assert set(QUERIES) - set(SQL) == {"goldstein", "emi", "phase_link"}


def test_entry(spark, data):
    assert registry.entry(spark, data).count() > 0
