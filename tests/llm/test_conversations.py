"""Prefix trie and repair of conversations against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidelake.llm import conversation_repair, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, c string, base string, key string, node string, rank string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "mine", "mine", "mine", "mine", "mine") for r in rows], SCHEMA).repartition(parts)


def in_order(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def brute_trie(rows):
    own = in_order(rows)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = lambda p: [p, *(q for k in children[p] for q in below(k))]
    out = []
    for p, cs in members.items():
        under = below(p)
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q)
        ends = sorted(c for c in cs if len(built[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[q] for q in under), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def talks(seed, n=70, turns=("Hello there.", "How are you?", "", "No", "Fine thanks")):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-25, 200), n):
        for t in range(rng.choice((0, 1, 2, 3, 5, 9))):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(("user", "assistant", None)) if rng.random() < 0.4 else ("user", "assistant")[t % 2], rng.choice(turns) if rng.random() < 0.9 else None))
    return rows


TALKS = {
    "none": [],
    "one": [(5, 1, "user", "a b")],
    "only_turnless": [(21, 0, "user", "x"), (43, 0, "user", "y")],
    "copies": [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)],
    "no_id": [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "user", "word\x00 other")],
    "tied": [(c, 1, r, x) for c in (1, 2, 20) for r, x in (("user", "b"), ("user", "a"), ("assistant", "z"), ("user", "a"))],
    "long": [(c, t, "user", f"w{t if c < 30 else t * c}") for c in (1, 20, 21, 39, 41) for t in range(400)],
    **{f"random{k}": talks(k) for k in range(4)},
}


@pytest.mark.parametrize("name", list(TALKS))
@pytest.mark.parametrize("cells", [6, 1 << 20])
def test_prefix_trie(spark, name, cells, monkeypatch):
    """Blocks of a few cells put most nodes at an edge; shards cut the groups of copies."""
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    rows = prefix_trie.grafted(prefix_trie.turn_rows(frame(spark, TALKS[name])))
    if cells == 6:
        rows = rows.select("c", "turns")
        got = _blocks_in_process(spark, rows)
    else:
        got = sorted((tuple(r) for r in prefix_trie.nodes(rows).collect()), key=str)
    assert got == brute_trie(TALKS[name])


def _blocks_in_process(spark, rows):
    """The steps of ``nodes`` in this process, where the size of a block can be set, over shards of seven rows."""
    import pyarrow as pa

    keyed = sorted((bytes.fromhex("".join(t["id"] for t in r["turns"])), r["c"], [t["n"] for t in r["turns"]]) for r in rows.collect())
    shards = [keyed[i : i + 7] for i in range(0, len(keyed), 7)]
    edges = [prefix_trie._shared(a[-1][0], b[0][0]) for a, b in itertools.pairwise(shards)]
    found = []
    for k, shard in enumerate(shards):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.list_(pa.int32()))], ["key", "c", "n"]) for part in (shard[:3], shard[3:]) if part]
        for batch in prefix_trie._shard(iter(batches), k, edges[k - 1] if k else -1, edges[k] if k < len(edges) else -1):
            found += batch.to_pylist()
    parts = sorted((r for r in found if r["node"] is not None), key=lambda r: (r["node"], r["shard"], r["block"]))
    whole = [r for b in prefix_trie._recombined(iter([prefix_trie._batch({c: [p[c] for p in parts] for c in prefix_trie.PART.names})])) for r in b.to_pylist()] if parts else []
    smallest = {r["node"]: r["conv_id"] for r in whole}
    every = [r for r in found if r["node"] is None] + whole
    for r in every:
        if r["parent"] is not None:
            r["parent_conv_id"] = smallest[r["parent"]]
    return sorted((tuple(r[c] for c in prefix_trie.NODE.names) for r in every), key=str)


# --- repair --------------------------------------------------------------------------


def brute_repair(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        by[c].append((t is not None, t or 0, r, x, code))
    out = []
    for c, list_ in by.items():
        said = []
        for has, t, r, x, code in sorted(list_):
            x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
            r = "user" if code == 4 else r
            said += [] if code == 0 else [(t if has else None, r, x)] * (2 if code == 3 else 1)
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, r, x in said:
            visible = re.sub(r"[\x20\x09-\x0D]", "", x)
            faults.append("b" if not visible else "d" if (r, x) in seen else "t" if visible[-1] not in ".!?" else "")
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = best_edits([(r, x, f) for (_, r, x), f in zip(said, faults)])
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(repaired))))
    return sorted(out, key=str)


def best_edits(rows):
    """All edits of cost up to the best, by dynamic programming over every role sequence, without an agenda."""
    best = {(0, ""): (0, "", [])}  # by rows read and initials given (as "", "s", "u" or "a" for the last one)

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(table):
        for _ in range(3):
            for last, (cost, audit, text) in list(table.items()):
                role = "assistant" if last == "u" else "user"
                better(table, role[0], (cost + 2, audit + "I", [*text, f"{role}:"]))
        return table

    now = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for last, (cost, audit, kept) in now.items():
            better(after, last, (cost + 3, audit + "D", kept))
            if fault in "bd" and fault:
                continue
            extra = int(fault == "t")
            if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[last] and role:
                better(after, role[0], (cost + extra, audit + "K", [*kept, f"{role}:{text}"]))
            new = "assistant" if last == "u" else "user"
            better(after, new[0], (cost + 2 + extra, audit + "R", [*kept, f"{new}:{text}"]))
        now = inserted(after)
    return min(now[k] for k in ("", "a") if k in now)


def exhaustive(rows, limit):
    """The least (cost, audit) of all audits up to a length, by trying each of them."""
    best = None
    for n in range(limit + 1):
        for audit in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in audit) != len(rows):
                continue
            left, roles, cost, ok = list(rows), "", 0, True
            for e in audit:
                row = None if e == "I" else left.pop(0)
                due = "a" if roles.endswith("u") else "u"
                if e == "D":
                    cost += 3
                    continue
                ok &= row is None or row[2] not in ("b", "d")
                roles += row[0][:1] if e == "K" else due
                cost += {"I": 2, "K": 0, "R": 2}[e] + (row is not None and row[2] == "t")
            if ok and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, "".join(audit)), (cost, "".join(audit)))
    return best


def test_agenda_finds_the_least_of_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(("system", "user", "assistant", "tool", " ")), "x", rng.choice(("", "", "t", "b", "d"))) for _ in range(rng.randint(0, 4))]
        (value,) = conversation_repair.lightest({conversation_repair.BEGIN: (0, "")}, [conversation_repair.Row(*r) for r in rows], True).values()
        assert value == exhaustive(rows, len(rows) + 2) == best_edits(rows)[:2]


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_blocks_of_a_long_conversation(block, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rng = random.Random(block)
    for length in (0, 1, 5, 40, 700):
        for odd in (0.02, 0.5, 1):
            rows = [((rng.choice(("system", "user", "assistant", "tool")) if rng.random() < odd else ("user", "assistant")[k % 2]), f"{k}", rng.choice(("", "t", "b", "d")) if rng.random() < odd else "") for k in range(length)]
            now = conversation_repair.Conversation(1)
            for k, r in enumerate(rows):
                now.read(k, conversation_repair.Row(*r))
                assert len(now.open) < 4 * block + 40
            cost, audit, text = best_edits(rows)
            assert now.end()[6:] == (cost, audit, sha("\n".join(text)))


ROWS = {
    "none": [],
    "nulls": [(None, None, None, None), (None, 2, "user", "x."), (4, None, "user", "a"), (4, None, None, "b."), (4, 7, "assistant", None)],
    "all_lost": [(c, 0, "user", "x.") for c in range(60)],
    "ties": [(c, 1, r, x) for c in range(30) for r, x in (("user", "b."), ("assistant", "c"), ("user", "b."), ("user", "a!"))],
    "long": [(9, t, ("user", "assistant", "system")[t % 3 if t % 11 == 0 else t % 2], f"t {t % 500}" + "." * (t % 7 > 0)) for t in range(3000)],
    "very_long_text": [(1, t, "user", "word " * 200_000) for t in range(2)],
    **{f"random{k}": [(c, t, r, x and x * random.Random(c).choice((1, 2))) for c, t, r, x in talks(k, turns=("Hello there.", "How are you?", "No", "Fine\t\n", " .", "x"))] for k in range(4)},
}


@pytest.mark.parametrize("name", list(ROWS))
def test_conversation_repair(spark, name):
    got = conversation_repair.repair(conversation_repair.damaged(frame(spark, ROWS[name])))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repair(ROWS[name])
