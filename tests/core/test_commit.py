"""The commit of episodes in waves against a plain loop over episodes; conflict waves; candidates; ends of validity."""

import hashlib
import random
from datetime import datetime, timedelta

from memloom.operators import atoms, commit, resolve
from pyspark.sql import functions as F

NOW = datetime(2024, 6, 1)
DAY = timedelta(days=1)
ATOM = "atom_id string, owner_id string, content string, valid_at timestamp, invalid_at timestamp, created_at timestamp, expired_at timestamp, seq long, subject_entity_id string, object_entity_id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def entity(name):
    return f"entity-{sha(name.lower())[:32]}"


def relation(a, b):
    return "relation-" + hashlib.md5((min(a, b) + max(a, b)).encode()).hexdigest()


def atom(episode, owner, content, seq):
    return "atom-" + sha("\x1f".join((str(episode), owner, content, str(seq))))[:32]


def active(x):
    return x["expired"] is None and (x["valid"] is None or x["valid"] <= NOW) and (x["invalid"] is None or x["invalid"] > NOW)


def plain_loop(stored, episodes, decisions):
    """Registry atoms, evidence and evolution after one episode at a time. stored: atoms by id, episodes: lists of facts in order."""
    evidence, evolution, revision = set(), [], {}
    for facts in episodes:
        for f in facts:
            revision.setdefault(f["owner"], 0)
        for owner in {f["owner"] for f in facts}:
            revision[owner] += 1
            own = sorted((f for f in facts if f["owner"] == owner), key=lambda f: f["seq"])
            first, lead, before = {}, {}, []
            for f in own:  # exact doubles, then decisions within the episode
                same = first.setdefault((" ".join(f["content"].split()), f["invalid"]), f["id"])
                lead[f["id"]] = lead[same] if same != f["id"] else f["id"]
                if same != f["id"]:
                    continue
                d = next((d for d in decisions.get(f["id"], []) if d["target"] in before), None)
                if d and d["kind"] == "DUPLICATE":
                    lead[f["id"]] = lead[d["target"]]
                before.append(f["id"])
            leaders = [f for f in own if lead[f["id"]] == f["id"]]
            history = sorted((x for x in stored.values() if x["owner"] == owner), key=lambda x: x["seq"])
            place, acts, new = {}, [], []
            for f in leaders:
                same = next((x for x in history if active(x) and " ".join(x["content"].split()) == " ".join(f["content"].split()) and x["invalid"] == f["invalid"]), None)
                d = next((d for d in decisions.get(f["id"], []) if d["target"] in {x["id"] for x in history}), None) if not same else None
                if same or (d and d["kind"] == "DUPLICATE"):
                    place[f["id"]] = same["id"] if same else d["target"]
                    continue
                place[f["id"]] = f["id"]
                new.append(f)
                if d and d["kind"] in atoms.DECISIONS and d["kind"] != "INDEPENDENT":
                    acts.append((f["id"], d["target"], d))
            last = max((x["seq"] for x in history), default=-1)
            for k, f in enumerate(new):
                stored[f["id"]] = {"id": f["id"], "owner": owner, "content": f["content"], "valid": f["valid"], "invalid": f["invalid"], "expired": None, "seq": last + 1 + k}
            for f in leaders:
                d = next((d for d in decisions.get(f["id"], []) if d["target"] in before), None)
                if d and d["kind"] in atoms.DECISIONS and d["kind"] not in ("DUPLICATE", "INDEPENDENT"):
                    acts.append((place[f["id"]], place[lead[d["target"]]], d))
            for source, target, d in acts:
                if source == target:
                    continue
                evolution.append((source, target, d["kind"]))
                s, t = stored[source], stored[target]
                if d["kind"] == "CONTRADICTION" and not d["supersedes"]:
                    continue
                end = {"REFINEMENT": None, "CONTRADICTION": d["end"], "TEMPORAL_SUCCESSOR": d["end"] or s["valid"]}[d["kind"]]
                if end is not None and (t["valid"] is None or end >= t["valid"]):
                    t["invalid"] = end
                t["expired"] = t["expired"] or NOW
            for f in own:
                evidence.add((f"evidence-{f['id']}", place[lead[f["id"]]], f["episode"]))
    return stored, evidence, evolution, revision


def made(seed, n_episodes=9):
    rng = random.Random(seed)
    names = ["Ann", "Bob", "Cid", "Dora", "Eve"]
    ids = {n: entity(n) for n in names} | {"Ann": "known-ann", "Bob": "known-bob"}
    stored, episodes, mentions, edges, decisions = {}, [], [], [], {}
    for k in range(6):
        owner = ids[names[k % 2]]
        stored[f"old-{k}"] = {"id": f"old-{k}", "owner": owner, "content": f"fact {k % 4}", "valid": NOW - (60 - k) * DAY, "invalid": None, "expired": None, "seq": k}
    told = {owner: [x for x in stored if stored[x]["owner"] == owner] for owner in ids.values()}
    for e in range(n_episodes):
        here, facts = rng.sample(names, rng.randint(1, 2)), []
        mentions += [(e, n, 10 * e + i, [n.upper()], "person") for i, n in enumerate(here)]
        places = [(ids[n], n, None) for n in here]
        if len(here) == 2:
            edges.append((e, here[0], here[1], ["knows"]))
            places.append((relation(ids[here[0]], ids[here[1]]), here[0], here[1]))
        own = {}
        for k in range(rng.randint(2, 7)):
            owner, a, b = rng.choice(places)
            seq, content = 100 * e + k, rng.choice(["fact 0", "fact  1", "fact 1", f"new {e}-{k}", f"new {e}-{k}"])
            f = {"id": atom(e, owner, content, seq), "episode": e, "owner": owner, "a": a, "b": b, "seq": seq, "content": content, "valid": rng.choice([None, NOW - rng.randint(1, 90) * DAY]), "invalid": rng.choice([None, None, NOW + 9 * DAY])}
            for pool in (own.get(owner, []), told.get(owner, [])):
                if pool and rng.random() < 0.6:
                    d = {"kind": rng.choice([*atoms.DECISIONS, "NONSENSE"]), "target": rng.choice(pool), "end": rng.choice([None, NOW - rng.randint(1, 90) * DAY]), "supersedes": rng.random() < 0.5}
                    decisions.setdefault(f["id"], []).append(d)
            facts.append(f)
            own.setdefault(owner, []).append(f["id"])
        for owner, some in own.items():
            told.setdefault(owner, []).extend(some)
        episodes.append(facts)
    return ids, stored, episodes, mentions, edges, decisions


def committed(spark, ids, stored, episodes, mentions, edges, decisions):
    make = spark.createDataFrame
    old = [(x["id"], x["owner"], x["content"], x["valid"], x["invalid"], NOW - 99 * DAY, x["expired"], x["seq"], None, None) for x in stored.values()]
    registry = {
        "entities": make([(ids[n], n, "person") for n in ("Ann", "Bob")], "entity_id string, canonical_name string, entity_type string"),
        "aliases": make([(ids[n], n.lower()) for n in ("Ann", "Bob")], "entity_id string, normalized_alias string"),
        "relations": make([], "a string, b string, keywords array<string>"),
        "atoms": make(old, ATOM),
        "evidence": make([], "evidence_id string, atom_id string, episode_id long"),
        "evolution": make([], "source_atom_id string, target_atom_id string, relation_type string, created_at timestamp"),
        "outbox": make([("known-ann", 5)], "owner_id string, target_revision long"),
    }
    facts = [f for e in episodes for f in e]
    told = make([(f["episode"], f["a"], f["seq"], f["content"], f["valid"], f["invalid"]) for f in facts if f["b"] is None], "episode_id long, name string, seq long, content string, valid_at timestamp, invalid_at timestamp")
    between = make([(f["episode"], f["a"], f["b"], f["seq"], f["content"], f["valid"], f["invalid"]) for f in facts if f["b"]], "episode_id long, src string, tgt string, seq long, content string, valid_at timestamp, invalid_at timestamp")
    chosen = make([(i, d["kind"], d["target"], d["end"], d["supersedes"]) for i, ds in decisions.items() for d in ds], "atom_id string, decision string, target_id string, target_invalid_at timestamp, supersedes boolean")
    return commit.commit_episodes(
        registry,
        make(mentions, "episode_id long, name string, seq long, aliases array<string>, entity_type string"),
        make(edges, "episode_id long, src string, tgt string, keywords array<string>"),
        told,
        make(list(ids.items()), "name string, entity_id string"),
        chosen,
        make([], "atom_id string, candidate_id string, score double"),
        F.lit(NOW),
        make([(e, NOW - (50 - e) * DAY) for e in range(len(episodes))], "episode_id long, created_at timestamp"),
        between,
    )


def test_waves_equal_a_plain_loop(spark):
    given = made(11)
    ids, stored, episodes, mentions, edges, decisions = given
    out = committed(spark, *given)
    want, evidence, evolution, revision = plain_loop({k: dict(v) for k, v in stored.items()}, episodes, decisions)
    got = {r.atom_id: r for r in out["atoms"].collect()}
    assert sorted(got) == sorted(want)
    for k, x in want.items():
        r = got[k]
        assert (r.owner_id, r.content, r.valid_at, r.invalid_at, r.expired_at is not None, r.seq) == (x["owner"], x["content"], x["valid"], x["invalid"], x["expired"] is not None, x["seq"]), k
        assert r.support_count == len({e for _, a, e in evidence if a == k})
    assert {(r.evidence_id, r.atom_id, r.episode_id) for r in out["evidence"].collect()} == evidence
    assert sorted((r.source_atom_id, r.target_atom_id, r.relation_type) for r in out["evolution"].collect()) == sorted(evolution)
    assert {r.relation_type for r in out["evolution"].collect()} >= {"REFINEMENT", "TEMPORAL_SUCCESSOR", "CONTRADICTION"}
    named = {n for _, n, *_ in mentions}
    assert {(r.entity_id, r.canonical_name) for r in out["entities"].collect()} == {(ids[n], n) for n in named | {"Ann", "Bob"}}
    assert {(r.a, r.b) for r in out["relations"].collect()} == {tuple(sorted((ids[s], ids[t]))) for _, s, t, _ in edges}
    assert {r.owner_id: r.target_revision for r in out["outbox"].collect()} == {o: n + (5 if o == "known-ann" else 0) for o, n in revision.items()}
    of_relations = [r for r in got.values() if r.owner_id.startswith("relation-")]
    assert of_relations and all(relation(r.subject_entity_id, r.object_entity_id) == r.owner_id for r in of_relations)


def test_nothing_to_commit(spark):
    given = made(11)
    out = committed(spark, given[0], given[1], [], [], [], {"x": [{"kind": "DUPLICATE", "target": "old-0", "end": None, "supersedes": False}]})
    assert out["atoms"].count() == len(given[1]) and out["outbox"].count() == 0


def test_conflict_waves_are_longest_chains(spark):
    rng = random.Random(2)
    episodes = [(e, rng.randint(0, 20)) for e in range(60)]
    keys = [(e, f"k{rng.randint(0, 25)}") for e, _ in episodes for _ in range(rng.randint(0, 3))]
    order, wave = sorted(episodes, key=lambda x: (x[1], x[0])), {}
    for n, (e, _) in enumerate(order):
        mine = {k for x, k in keys if x == e}
        wave[e] = 1 + max((wave[x] for x, _ in order[:n] if mine & {k for y, k in keys if y == x}), default=0)
    got = commit.conflict_waves(spark.createDataFrame(episodes, "episode_id long, created_at long"), spark.createDataFrame(keys, "episode_id long, key string"))
    assert {r.episode_id: r.wave for r in got.collect()} == wave and max(wave.values()) > 4


def test_containing_names_conflict(spark):
    """A name within another is a candidate for it, so their episodes are ordered; names that share nothing are not."""
    rows = [(1, "Ann Smith", []), (2, "Ann", []), (3, "Zoe", ["zz"]), (4, "Yan", ["ZZ"]), (5, "Lone", [])]
    keys = commit.conflict_keys(spark.createDataFrame(rows, "episode_id long, name string, aliases array<string>"), spark.createDataFrame([("Lone", "e5")], "name string, entity_id string"))
    got = commit.conflict_waves(spark.createDataFrame([(e, 0) for e in range(1, 6)], "episode_id long, created_at long"), keys)
    assert {r.episode_id: r.wave for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}


def test_ends_are_tested_each(spark):
    """A target of 10 January with successors of 1 January and 1 February ends on 1 February; a contradiction without an end sets none."""
    day = lambda m, d: datetime(2024, m, d)
    rows = [("t", day(1, 10), 0), ("a", day(1, 1), 1), ("b", day(2, 1), 2), ("u", day(1, 10), 3), ("c", day(3, 1), 4)]
    df = spark.createDataFrame([(i, "o", i, v, None, None, None, s, None, None) for i, v, s in rows], ATOM)
    d = spark.createDataFrame([("a", "TEMPORAL_SUCCESSOR", "t", None, False), ("b", "TEMPORAL_SUCCESSOR", "t", None, False), ("c", "CONTRADICTION", "u", None, True)], "atom_id string, decision string, target_id string, target_invalid_at timestamp, supersedes boolean")
    out = {r.atom_id: r for r in atoms.apply_evolution(df, d, F.lit(NOW))[0].collect()}
    assert out["t"].invalid_at == day(2, 1) and out["t"].expired_at and out["u"].invalid_at is None and out["u"].expired_at


def test_one_entity_of_one_normal_name(spark):
    make = spark.createDataFrame
    got = resolve.apply_entity_decisions(
        make([("Alice", "person", ["Alice"]), ("ALICE", "person", ["ALICE"])], "name string, entity_type string, aliases array<string>"),
        make([], "name string, entity_id string"), make([], "name string, entity_id string, canonical_name string"), make([], "entity_id string, normalized_alias string"),
    ).collect()
    assert len({(r.entity_id, r.canonical_name) for r in got}) == 1 and len(got) == 2
