"""Prefix trie, centroid clustering and WARC archives against plain versions, with edge cases."""

import base64
import glob
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliant.llm import centroid_clusters, prefix_trie, warc

TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations(seed=1):
    rng, rows = random.Random(seed), []
    for c in range(-30, 200):
        kind, n = rng.random(), rng.randint(1, 6)
        if kind < 0.1:
            continue
        if kind < 0.4:  # a third are copies of one
            turns = [("user", "a b"), ("bot", "c")]
        else:
            turns = [(rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "d\x0be \x1c f", "", None])) for _ in range(n)]
        rows += [(c, None if rng.random() < 0.05 else t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(3, 0, "user", "again")] * 2 + [(None, 1, "x", "y")] * 3
    return rows + [(901, t, "user", f"w {t}") for t in range(300)] + [(902, t, "user", f"w {t}") for t in range(299)]


@pytest.mark.parametrize("block_bytes,part_bytes", [(1 << 20, 1 << 20), (400, 20000), (1, 4000)])
def test_trie_is_the_plain_one_whatever_the_blocks(spark, block_bytes, part_bytes):
    rows = some_conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert rows_of(prefix_trie.nodes(df, block_bytes=block_bytes, part_bytes=part_bytes)) == plain_trie(rows)


def test_trie_edges(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.nodes(none).collect() == []
    one = [(1, None, None, None)]  # crc32("1") % 4 is 3: the turn goes, and the family has no first conversation
    assert rows_of(prefix_trie.nodes(spark.createDataFrame(one, TURNS))) == plain_trie(one) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    clash = spark.createDataFrame([(0, 1, "r", "t", 9, "k")], TURNS + ", depth long, key string")
    assert rows_of(prefix_trie.nodes(clash)) == plain_trie([(0, 1, "r", "t")])


def test_extents_are_those_of_a_walk():
    rng = np.random.default_rng(0)
    lcp = np.append(-1, rng.integers(0, 5, 200))
    levels = prefix_trie.sparse_table(lcp)
    row, depth = (x.ravel() for x in np.meshgrid(np.arange(201), np.arange(6)))
    left, right = prefix_trie.extent_left(levels, row, depth), prefix_trie.extent_right(levels, row, depth)
    for i, d, a, b in zip(row, depth, left, right):
        x = y = i
        while x > 0 and lcp[x] >= d:
            x -= 1
        while y < 200 and lcp[y + 1] >= d:
            y += 1
        assert (x, y) == (a, b)
    assert (prefix_trie.range_min(levels, left, right) == [lcp[a : b + 1].min() for a, b in zip(left, right)]).all()


def plain_clusters(rows, clusters=8, rounds=10, dim=64, scale=1024):
    v = [(i, [math.floor(scale * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [x for _, x in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [min(range(len(centers)), key=lambda c: (far(x, centers[c]), c)) for _, x in v]
    for _ in range(rounds):
        now = nearest()
        for c in range(len(centers)):
            if own := [x for (_, x), k in zip(v, now) if k == c]:
                centers[c] = [sum(t) // len(own) for t in zip(*own)]
    now = nearest()
    away = [far(x, centers[c]) for (_, x), c in zip(v, now)]
    inertia = [sum(d for d, k in zip(away, now) if k == c) for c in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(away), digest[c]) for (i, _), c, d in zip(v, now, away)), key=repr)


def vector_tables():
    rng = random.Random(2)
    vec = lambda s=1.0: [rng.uniform(-s, s) for _ in range(64)]
    base = vec()
    odd = [(None, vec()), (7, base), (7, base), (8, None), (9, [1.0] * 63), (10, [None] + [0.0] * 63), (11, [float("nan")] * 64), (12, [float("inf")] * 64), (13, [])]
    return {
        "mixed": [(i, vec()) for i in range(40)] + odd + [(100 + i, base) for i in range(60)],
        "one": [(1, base)], "five": [(i, vec()) for i in range(5)], "copies": [(i, base) for i in range(30)],
        "large": [(i, vec(1e5)) for i in range(50)], "line": [(i, [float(i)] * 64) for i in range(50)],
        "groups": [(i, [10.0 * (i % 9) + x for x in vec(0.1)]) for i in range(90)],
    }


@pytest.mark.parametrize("name", list(vector_tables()))
def test_clusters_are_the_plain_ones(spark, name):
    rows = vector_tables()[name]
    df = spark.createDataFrame([(i, e, "z", 0) for i, e in rows], "vec_id long, embedding array<double>, cluster string, v int")
    assert rows_of(centroid_clusters.cluster(df, rows=16)) == plain_clusters(rows)


def test_no_vectors_no_clusters_and_too_large_ones_are_an_error(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert centroid_clusters.cluster(df).collect() == [] and centroid_clusters.cluster(df.where("false")).collect() == []
    with pytest.raises(ValueError, match="too large"):
        centroid_clusters.distances(np.full((1, 64), 1 << 40), np.zeros((1, 64), np.int64))


def test_simplex_bounds_hold_and_decide():
    rng = np.random.default_rng(5)
    for trial in range(20):
        scale = int(10 ** rng.integers(1, 8))
        vectors = rng.integers(-scale, scale, (300, 64))
        pivots = np.vstack([rng.integers(-scale, scale, (int(rng.integers(1, 12)), 64)), *(vectors[:1],) * int(rng.integers(0, 3))])
        centroids = np.vstack([rng.integers(-scale, scale, (6, 64)), pivots[:2], vectors[5:6]])
        simplex = centroid_clusters.Simplex(pivots)
        apexes = simplex.project(vectors)
        lower, upper = simplex.bounds(apexes, simplex.project(centroids))
        exact = centroid_clusters.distances(vectors, centroids)
        assert (lower <= exact).all() and (exact <= upper).all()
        nearest, measured = centroid_clusters.assign(simplex, vectors, apexes, centroids)
        assert (nearest == exact.argmin(1)).all()
    # Centroids that are the pivots lie in their space: bounds meet, and hardly anything is measured.
    simplex = centroid_clusters.Simplex(centroids)
    assert centroid_clusters.assign(simplex, vectors, simplex.project(vectors), centroids)[1] < 0.05 * exact.size


PAGES = "page_id long, url string, html string"


def some_pages():
    rng = random.Random(3)
    rows = [
        (i, f"http://h{i % 7}.com/{i}\r\nX: y é %41", rng.choice(["<p>a", "", None, "<p>é" * 200, "WARC/1.0\r\nx" * 3, "\x1f\x8b\x08\0"]) if rng.random() < 0.6 else f"<p>{i}" * rng.randint(1, 50))
        for i in range(200)
    ]
    return rows + [(5, "u", "dup")] * 4 + [(None, None, "dup"), (None, "z", "only null"), (None, None, "only null"), (12, "a", "x"), (12, "b", "x")]


def plain_records(rows):
    best, seen, out = {}, Counter(), []
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", (False, 0)), (i is not None, i or 0))
    for i, _, h in rows:
        h = h or ""
        first = (i is not None, i or 0) == best[h] and not seen[h]
        seen[h] += first
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((i, len(h.encode()), digest, "response" if first else "revisit", None if first or not best[h][0] else best[h][1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_hold_a_record_for_each_page(spark, tmp_path, compressed):
    rows = some_pages()
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", sha1 string, number int")
    folder = str(tmp_path / "w")
    warc.write(pages, folder, compressed, archive_bytes=3000)
    assert len(glob.glob(folder + "/part-*")) > 10
    found = warc.read(spark, folder)
    assert rows_of(warc.page_records(found)) == plain_records(rows)
    assert found.where("reason is not null or after_gap").count() == 0
    texts = {r.payload.decode() for r in found.where("record_type = 'response'").collect()}
    assert texts == {h or "" for _, _, h in rows}
    for path in glob.glob(folder + "/part-*") if compressed else []:
        assert gzip.decompress(open(path, "rb").read()).startswith(b"WARC/1.1\r\n")


def test_no_pages_no_archives(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).collect() == []


def an_archive(compressed, n=40):
    parts = []
    for i in range(n):
        text = (f"<p>{i} WARC/1.0\r\n" + "é" * (i % 5)).encode() * (i % 9 + 1)
        made = warc.record("response", i, f"http://x/{i}", text, len(text), hashlib.sha1(text).hexdigest(), 0, None, "2000-01-01T00:00:00Z") + warc.END
        parts.append(zlib.compress(made, 6, 31) if compressed else made)
    return parts


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_whole_records_and_logs_the_rest(compressed):
    rng = random.Random(7)
    whole = list(warc.salvage(b"".join(an_archive(compressed))))
    assert len(whole) == 40 and not any("reason" in r for r in whole)
    for trial in range(60):
        parts = an_archive(compressed)
        hurt = {rng.randrange(40) for _ in range(rng.randint(1, 6))}
        for i in hurt:
            old, kind = parts[i], rng.randrange(4)
            at = rng.randrange(len(old))
            if kind == 0:  # bytes changed
                parts[i] = old[:at] + bytes([old[at] ^ (1 << rng.randrange(8))]) + old[at + 1 :]
            elif kind == 1:  # cut short
                parts[i] = old[:at]
            elif kind == 2:  # rubbish inside
                parts[i] = old[:at] + bytes(rng.randrange(256) for _ in range(30)) + old[at:]
            else:  # rubbish before
                parts[i] = bytes(rng.randrange(256) for _ in range(30)) + old
        data = b"".join(parts)
        out = list(warc.salvage(data))
        # Every byte belongs to one record or one gap, in order.
        assert [r["begin"] for r in out] == [0, *(r["end"] for r in out)][:-1] and (not out or out[-1]["end"] == len(data))
        good = [r for r in out if "reason" not in r]
        starts = np.cumsum([0, *(len(p) for p in parts)])
        for i in set(range(40)) - hurt:
            assert any(r["begin"] == starts[i] and r["end"] == starts[i + 1] and r["record_id"].startswith(f"<urn:x-page:{i}:") for r in good), (trial, i)
        for r in good:  # nothing else passes for a record, but for changes in fields that no digest covers
            found = re.match(r"<urn:x-page:(\d+):", r["record_id"] or "")
            i = int(found[1]) if found else 40
            assert i >= 40 or i in hurt or r["payload"] == whole[i]["payload"]


def test_salvage_of_plain_cases(spark, tmp_path):
    parts = an_archive(True, 5)
    assert [r["reason"] for r in warc.salvage(b"rubbish")] == ["version line"] and list(warc.salvage(b"")) == []
    cut = list(warc.salvage(b"".join(parts)[:-7]))
    assert len(cut) == 5 and cut[-1]["reason"] == "truncated"
    one = zlib.compress(b"".join(an_archive(False, 5)), 6, 31)  # all records in one member
    assert [r["payload_bytes"] for r in warc.salvage(one)] == [r["payload_bytes"] for r in warc.salvage(b"".join(parts))]
    for name, bad in (("length", b"Content-Length: x"), ("truncated", b"Content-Length: 99999"), ("record end", b"Content-Length: 5")):
        text = an_archive(False, 1)[0]
        hurt = re.sub(rb"(?m)^Content-Length: \d+(?=\r\n\r\nHTTP)", bad, text)
        assert [r.get("reason") for r in warc.salvage(hurt + parts[1])] == [name, None]
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "x.warc.gz").write_bytes(parts[0] + b"\x1f\x8b\x08rubbish" + parts[1])
    found = warc.read(spark, str(folder)).orderBy("begin").collect()
    assert [(r.reason, r.after_gap) for r in found] == [(None, False), ("gzip member", False), (None, True)]


def test_salvage_of_many_false_marks_is_quick():
    text = b"WARC/1.0\r\nA: b\r\n" * 50_000 + b"\x1f\x8b\x08" * 50_000
    out = list(warc.salvage(text + an_archive(False, 1)[0]))
    assert len(out) == 2 and out[0]["end"] == len(text)
