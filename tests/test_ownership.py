"""Window queries to instances, against a sequential restatement."""

import numpy as np
import pytest

from sheetloom.operators import ownership as own

IGNORE, STUFF, LABELS = 5, (3, 4), 6


def windows(seed, n_win=4, n_query=7, n_prim=9):
    """Random windows of a page, half of whose primitives the next window has too."""
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (3, 6))
    out = []
    for w in range(n_win):
        logits = rng.normal(0, 2, (n_query, LABELS))
        out.append({"ids": [w * 5 + k for k in range(n_prim)], "logits": logits, "quality": rng.normal(0, 2, n_query), "mask": rng.normal(0, 3, (n_query, n_prim)), "owner": rng.normal(0, 2, (n_prim, n_query + 1)), "identity": base[rng.integers(0, 3, n_query)] + rng.normal(0, 0.2, (n_query, 6)), "places": {}})
    return out


def tables(spark, pages):
    q, m, o, n = [], [], [], []
    for page, rows in pages.items():
        for w, r in enumerate(rows):
            for k in range(len(r["logits"])):
                q.append((page, w, k, r["logits"][k].tolist(), float(r["quality"][k]), r["identity"][k].tolist()))
                m += [(page, w, k, pid, float(r["mask"][k, j])) for j, pid in enumerate(r["ids"])]
                o += [(page, w, k, pid, float(r["owner"][j, k])) for j, pid in enumerate(r["ids"])]
            n += [(page, w, pid, float(r["owner"][j, -1])) for j, pid in enumerate(r["ids"])]
    key = "page long, win int, query int, "
    return (spark.createDataFrame(q, key + "logits array<double>, quality double, identity array<double>"), spark.createDataFrame(m, key + "primitive long, logit double"), spark.createDataFrame(o, key + "primitive long, logit double"), spark.createDataFrame(n, "page long, win int, primitive long, null_logit double"))


sigmoid = lambda x: 1 / (1 + np.exp(-x))


def plain(rows, membership):
    """{primitive: track}, {track: (label, score, fragments)} and the rejected queries, one after the other."""
    cands, rejected = [], {}
    for w, r in enumerate(rows):
        for k, logit in enumerate(r["logits"]):
            p = np.exp(logit) / np.exp(logit).sum()
            label, mask = int(p[:IGNORE].argmax()), sigmoid(r["mask"][k])
            mask_score = float(mask[mask > 0.01].mean()) if (mask > 0.01).any() else 0.0
            score = p[label] * sigmoid(r["quality"][k]) * mask_score
            if p.argmax() == IGNORE or logit[label] - logit[IGNORE] < 0.3 or score < 0.1:
                rejected[w, k] = "no_object" if p.argmax() == IGNORE else "low_object_margin" if logit[label] - logit[IGNORE] < 0.3 else "low_score"
                continue
            cands.append({"w": w, "k": k, "label": label, "score": score, "id": r["identity"][k], "support": {pid: float(c) for pid, c in zip(r["ids"], mask, strict=True) if c >= 0.25}, "mask": dict(zip(r["ids"], mask, strict=True))})
    track = {i: ("thing", i) for i in range(len(cands))}
    for w in range(len(rows) - 1):
        pair = {}
        for i, a in enumerate(cands):
            for j, b in enumerate(cands):
                if a["w"] == w and b["w"] == w + 1 and a["label"] == b["label"] < STUFF[0]:
                    cosine = a["id"] @ b["id"] / (np.linalg.norm(a["id"]) * np.linalg.norm(b["id"]))
                    both = sum(min(a["support"][x], b["support"][x]) for x in a["support"].keys() & b["support"].keys())
                    pair[i, j] = 0.65 * (cosine + 1) / 2 + 0.35 * both / max(min(sum(a["support"].values()), sum(b["support"].values())), 1e-8)
        for (i, j), s in pair.items():
            if s >= 0.55 and s == max(v for (a, _), v in pair.items() if a == i) and s == max(v for (_, b), v in pair.items() if b == j):
                old, new = max(track[i], track[j]), min(track[i], track[j])
                track = {x: new if t == old else t for x, t in track.items()}
    name = {i: f"stuff {c['label']}" if STUFF[0] <= c["label"] <= STUFF[1] else f"thing {cands[track[i][1]]['w']} {cands[track[i][1]]['k']}" for i, c in enumerate(cands)}
    owner = {}
    for w, r in enumerate(rows):
        for j, pid in enumerate(r["ids"]):
            best = owner.setdefault(pid, {})
            for i, c in enumerate(cands):
                if c["w"] == w and (membership is None or c["mask"][pid] >= membership):
                    best[name[i]] = max(best.get(name[i], 0.0), r["owner"][j, c["k"]] - r["owner"][j, -1])
    owned = {pid: max(e, key=e.get) if e and max(e.values()) > 0 else None for pid, e in owner.items()}
    top = {}
    for t in set(owned.values()) - {None}:
        members = [c for i, c in enumerate(cands) if name[i] == t]
        top[t] = (max(members, key=lambda c: c["score"])["label"], max(c["score"] for c in members), len(members), sum(v == t for v in owned.values()))
    return owned, top, rejected


@pytest.mark.parametrize("membership", [None, 0.5])
def test_owners_equal_a_sequential_decode(spark, membership):
    pages = {k: windows(k) for k in (1, 2, 3)}
    q, m, o, n = tables(spark, pages)
    judged = own.admitted_queries(q, m, IGNORE, least_score=0.1, least_margin=0.3)
    tracks = own.query_tracks(judged, m, STUFF)
    owners = own.primitive_owners(tracks, m, o, n, membership)
    got = owners.collect()
    found = {(r.page, r.track): r for r in own.track_instances(judged, tracks, owners).collect()}
    reasons = {(r.page, r.win, r.query): r.reason for r in judged.filter("reason is not null").collect()}
    merged = 0
    for page, rows in pages.items():
        want, top, rejected = plain(rows, membership)
        assert {r.primitive: r.track for r in got if r.page == page} == want
        assert {k[1:]: v for k, v in reasons.items() if k[0] == page} == rejected
        assert {t: (r.label, pytest.approx(r.score), r.fragments, r.primitives) for (p, t), r in found.items() if p == page} == top
        merged += sum(v[2] > 1 for v in top.values())
    assert merged > 3


def test_masks_grow_by_nearness_and_keep_their_label(spark):
    rng = np.random.default_rng(3)
    pages = {5: windows(5, 2, 5, 9)}
    q, m, _, _ = tables(spark, pages)
    place = {pid: rng.uniform(0, 30, (3, 2)) for pid in range(20)}
    places = spark.createDataFrame([(5, k, [(float(x), float(y)) for x, y in v]) for k, v in place.items()], "page long, primitive long, points array<struct<x:double,y:double>>")
    judged = own.admitted_queries(q, m, IGNORE, least_score=0.0, respect_no_object=False)
    chosen = own.selected(m, judged, 0.6)
    grown = own.grown(chosen, m, places, 0.2, 9.0, 0.5).collect()
    labels = {k: int(rng.integers(0, 5)) for k in range(0, 20, 2)}
    kept = own.remasked(chosen, judged, spark.createDataFrame([(5, k, v) for k, v in labels.items()], "page long, primitive long, semantic int")).collect()
    added = 0
    for w, r in enumerate(pages[5]):
        for k in range(5):
            chance = dict(zip(r["ids"], sigmoid(r["mask"][k]), strict=True))
            base = {p for p, c in chance.items() if c >= 0.6}
            far = lambda p: min(np.linalg.norm(a - b) for s in base for a in place[s] for b in place[p])  # noqa: B023, E731
            more = sorted((p for p, c in chance.items() if base and p not in base and c >= 0.2 and far(p) <= 9), key=lambda p: (-chance[p], far(p)))  # noqa: B023
            want = base | set(more[: int(np.ceil(len(base) * 0.5))])
            assert {x.primitive for x in grown if (x.win, x.query) == (w, k)} == want
            added += len(want - base)
            label = int(r["logits"][k][:IGNORE].argmax())
            same = {p for p in base if labels.get(p, label) == label}
            assert {x.primitive for x in kept if (x.win, x.query) == (w, k)} == (same or base)
    assert added
    sem = own.semantic_labels(spark.createDataFrame([(1, 1, [0.0, 2.0, 1.0]), (1, 1, [3.0, 0.0, 1.0]), (1, 2, [1.0, 1.0, 0.0])], "page long, primitive long, logits array<double>")).collect()
    assert {(r.primitive, r.semantic) for r in sem} == {(1, 0), (2, 0)}
