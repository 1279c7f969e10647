"""The stateful batch planner: candidates drawn in keyed order, scored, selected, and packed step by step.

Planning is sequential within a branch and parallel over branches. Novelty looks at a window of recent sketch hashes,
counted as a multiset, so restored state equals live state.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .mixture import raise_to_floors
from .shards import fit

# Weights and thresholds of the selector.
WEIGHTS = {"utilisation": 0.35, "novelty": 0.30, "length_fit": 0.20, "lane_affinity": 0.15}
ACCEPT, DEFER, MAX_SYMBOLS = 0.68, 0.60, 0.03
WINDOW, MAX_OPEN, DRAWS_PER_BIN, MIN_DRAWS = 96 * 8, 8, 8, 6


def keyed(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


@dataclass
class State:
    """All that planning a later step needs."""

    step: int = 0
    drawn: Counter = field(default_factory=Counter)
    buffer: dict[str, list[str]] = field(default_factory=dict)
    deferred: dict[str, list[str]] = field(default_factory=dict)
    seen: set[str] = field(default_factory=set)
    recent: deque = field(default_factory=lambda: deque(maxlen=WINDOW))

    def dump(self) -> str:
        return json.dumps({"step": self.step, "drawn": dict(sorted(self.drawn.items())), "buffer": dict(sorted(self.buffer.items())), "deferred": dict(sorted(self.deferred.items())), "seen": sorted(self.seen), "recent": list(self.recent)}, sort_keys=True, separators=(",", ":"))

    @classmethod
    def load(cls, raw: str) -> State:
        x = json.loads(raw)
        return cls(x["step"], Counter(x["drawn"]), x["buffer"], x["deferred"], set(x["seen"]), deque(x["recent"], WINDOW))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.dump().encode()).hexdigest()


class Planner:
    """One branch. samples: (sample_id, lane, n_tokens, token_hash, symbol_ratio, sketch)."""

    def __init__(self, samples: pd.DataFrame, stage_of, quota_of, floors_of, shares_of, seq_len: int, branch: object, state: State | None = None):
        self.by_id = {r.sample_id: r for r in samples.itertuples()}
        self.pool: dict[str, list[str]] = {}
        for s, lane in zip(samples.sample_id, samples.lane):
            self.pool.setdefault(lane, []).append(s)
        self.stage_of, self.quota_of, self.floors_of, self.shares_of = stage_of, quota_of, floors_of, shares_of
        self.seq_len, self.branch, self.state = seq_len, branch, state or State()
        self.live = Counter(self.state.recent)
        self.orders: dict[tuple[str, int], list[str]] = {}

    def order(self, lane: str, epoch: int) -> list[str]:
        if (lane, epoch) not in self.orders:
            self.orders[lane, epoch] = sorted(self.pool[lane], key=lambda s: keyed(self.branch, lane, epoch, s))
        return self.orders[lane, epoch]

    def draw(self, lane: str) -> tuple[str, int]:
        n = self.state.drawn[lane]
        self.state.drawn[lane] += 1
        epoch, at = divmod(n, len(self.pool[lane]))
        return self.order(lane, epoch)[at], epoch

    def features(self, r, stage: str) -> dict[str, float]:
        sketch = list(r.sketch)
        novelty = 1 - sum(x in self.live for x in sketch) / len(sketch) if sketch else 0.0
        return {"utilisation": round(min(1.0, r.n_tokens / (self.seq_len - 1)), 6), "novelty": round(novelty, 6), "length_fit": round(min(1.0, r.n_tokens / 64), 6), "lane_affinity": round(self.shares_of(stage).get(r.lane, 0.0), 6)}

    def decide(self, s: str, stage: str) -> tuple[str, str, float]:
        r = self.by_id[s]
        f = self.features(r, stage)
        score = round(sum(WEIGHTS[k] * f[k] for k in WEIGHTS), 6)
        if r.symbol_ratio > MAX_SYMBOLS:
            return "rejected", "symbol_heavy_content", score
        if r.token_hash in self.state.seen:
            return "deferred", "duplicate_token_span", score
        if score < DEFER:
            return "rejected", "low_" + min(f, key=lambda k: (f[k] * WEIGHTS[k], keyed(k))), score
        return ("deferred", "borderline_proxy_score", score) if score < ACCEPT else ("accepted", "score_above_threshold", score)

    def commit(self, s: str) -> None:
        r = self.by_id[s]
        self.state.seen.add(r.token_hash)
        for x in r.sketch:
            if len(self.state.recent) == WINDOW:
                old = self.state.recent[0]
                self.live[old] -= 1
                if not self.live[old]:
                    del self.live[old]
            self.state.recent.append(int(x))
            self.live[int(x)] += 1

    def packed(self, ids: list[str]) -> list[list[str]]:
        ids = sorted(ids, key=lambda s: (-self.by_id[s].n_tokens, s))
        out: dict[int, list[str]] = {}
        for s, b in zip(ids, fit([int(self.by_id[s].n_tokens) + 1 for s in ids], self.seq_len, True, MAX_OPEN)):
            out.setdefault(b, []).append(s)
        return list(out.values())

    def plan(self) -> tuple[list[tuple[str, list[str]]], list[tuple]]:
        """(bins, decisions) of the next step: bins are (lane, sample ids) in keyed order."""
        step, st = self.state.step, self.state
        stage = self.stage_of(step)
        floors = self.floors_of(stage)
        quota, _ = raise_to_floors(self.quota_of(stage), floors)
        placed, decisions = [], []
        for lane in sorted(x for x in quota if quota[x] > 0 and x in self.pool):
            buf, rejected, draws = list(st.buffer.get(lane, [])), [], 0
            waiting = st.deferred.setdefault(lane, [])
            if stage != self.stage_of(0):
                for s in [waiting.pop(0) for _ in range(min(quota[lane], len(waiting)))]:
                    status, reason, score = self.decide(s, stage)
                    status, reason = ("accepted", "deferred_reconsidered_accepted") if status == "deferred" else (status, f"deferred_reconsidered({reason})")
                    decisions.append((s, lane, status, reason, score, False))
                    if status == "accepted":
                        self.commit(s)
                        buf.append(s)
            while len(self.packed(buf)) < quota[lane] and draws < max(MIN_DRAWS, quota[lane] * DRAWS_PER_BIN):
                s, _ = self.draw(lane)
                draws += 1
                status, reason, score = self.decide(s, stage)
                decisions.append((s, lane, status, reason, score, False))
                if status == "accepted":
                    self.commit(s)
                    buf.append(s)
                elif status == "deferred":
                    waiting.append(s)
                else:
                    rejected.append((s, reason, score))
            if floors.get(lane, 0):
                for s, reason, score in sorted(rejected, key=lambda x: -x[2]):
                    if len(self.packed(buf)) >= quota[lane]:
                        break
                    decisions.append((s, lane, "accepted", f"protected_floor_override(was:{reason})", score, True))
                    self.commit(s)
                    buf.append(s)
            took = self.packed(buf)[: quota[lane]]
            used = {s for b in took for s in b}
            st.buffer[lane] = [s for s in buf if s not in used]
            placed += [(lane, b) for b in took]
        placed = [placed[k] for k in sorted(range(len(placed)), key=lambda k: keyed(self.branch, "order", step, k))]
        st.step += 1
        return placed, decisions


PLAN = "branch bigint, step bigint, kind string, lane string, nth bigint, sample_ids array<string>, status string, reason string, score double, override boolean, batch_hash string, fingerprint string"


def plan_branches(samples: DataFrame, stages: list[tuple[str, int, int]], quotas: dict[str, dict[str, int]], floors: dict[str, dict[str, int]], shares: dict[str, dict[str, float]], steps: int, seq_len: int, stop: int | None = None) -> DataFrame:
    """Rows of all branches' plans: bins (kind bin) and decisions (kind decision). Each branch plans over its samples. At
    step stop the state is dumped and a new planner goes on from it."""

    def stage_of(step: int) -> str:
        return next((n for n, a, b in stages if a <= step < b), stages[-1][0])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        branch = int(g.branch.iloc[0])
        p = Planner(g, stage_of, quotas.__getitem__, floors.__getitem__, shares.__getitem__, seq_len, branch)
        rows = []
        for step in range(steps):
            if step == stop:
                p = Planner(g, stage_of, quotas.__getitem__, floors.__getitem__, shares.__getitem__, seq_len, branch, State.load(p.state.dump()))
            placed, decisions = p.plan()
            sha = hashlib.sha256("|".join(keyed(lane, *b) for lane, b in placed).encode()).hexdigest()
            mark = p.state.fingerprint()
            rows += [(branch, step, "bin", lane, k, b, None, None, None, None, sha, mark) for k, (lane, b) in enumerate(placed)]
            rows += [(branch, step, "decision", lane, k, [s], status, reason, score, over, sha, mark) for k, (s, lane, status, reason, score, over) in enumerate(decisions)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    return samples.groupBy("branch").applyInPandas(one, PLAN)
