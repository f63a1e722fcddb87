"""Merging: golden rows and properties of the rows that are left."""

import json
import random

import pytest

from tidemark.operators import facts

SCHEMA = "seq BIGINT, pos BIGINT, path ARRAY<STRING>, kind STRING, value STRING"


def frame(spark, rows):
    return spark.createDataFrame([(s, p, path.split("."), k, v) for s, p, path, k, v in rows], SCHEMA)


def leaves(tree, path=()):
    for key, value in tree.items():
        at = (*path, key)
        if isinstance(value, dict):
            yield from leaves(value, at)
        elif isinstance(value, list):
            yield from ((at, "list", x) for x in value)
        else:
            yield at, "scalar", value


def test_scalars_later_wins(spark):
    f = frame(spark, [(0, 0, "policy", "scalar", "keep"), (1, 0, "policy", "scalar", "drop"),
                      (0, 1, "c.X.gender", "scalar", "male"), (1, 1, "c.X.gender", "scalar", "female"),
                      (2, 0, "c.X.style", "scalar", "rude")])
    got = {".".join(r.path): r.value for r in facts.merge_scalars(f).collect()}
    assert got == {"policy": "drop", "c.X.gender": "female", "c.X.style": "rude"}


@pytest.mark.parametrize("distinct, want", [(False, "abcc"), (True, "abc")])
def test_lists_keep_repeats_of_first_patch(spark, distinct, want):
    f = frame(spark, [(0, 0, "l", "list", "a"), (0, 1, "l", "list", "b"), (1, 0, "l", "list", "b"),
                      (1, 1, "l", "list", "c"), (1, 2, "l", "list", "c")])
    rows = facts.merge_lists(f, distinct).orderBy("seq", "pos").collect()
    assert "".join(r.value for r in rows) == want


def test_golden_change_of_kind(spark):
    rows = [(0, 0, "a", "scalar", "x"), (1, 0, "a", "list", "p"), (1, 1, "a", "list", "q"),  # list over scalar
            (0, 1, "b.c", "scalar", "x"), (0, 2, "b.d", "list", "y"), (2, 0, "b", "scalar", "z"),  # scalar over branch
            (0, 3, "e", "list", "u"), (1, 2, "e.f", "scalar", "v"),  # branch over list
            (0, 4, "g", "list", "1"), (1, 3, "g", "scalar", "2"), (2, 1, "g", "list", "3"), (3, 0, "g", "list", "1"),
            (0, 5, "h.i", "scalar", "old"), (3, 1, "h.i", "scalar", "new"), (3, 2, "h.j", "scalar", "k")]
    got = sorted((".".join(r.path), r.kind, r.value) for r in facts.merge_facts(facts.drop_overwritten(frame(spark, rows))).collect())
    assert got == [("a", "list", "p"), ("a", "list", "q"), ("b", "scalar", "z"), ("e.f", "scalar", "v"), ("g", "list", "1"), ("g", "list", "3"),
                   ("h.i", "scalar", "new"), ("h.j", "scalar", "k")]


def test_merge_properties(spark):
    """No path is of two kinds or above another, and each value is where its rows say."""
    rng = random.Random(7)
    rows = []
    for case in range(60):
        for seq in range(rng.randint(1, 6)):
            for pos in range(rng.randint(1, 4)):
                path = rng.choice(["a", "b", "a.d", "a.e", "b.d"])
                kind = rng.choice(["scalar", "list"])
                taken = {p: k for s, q, p, k, _ in rows if s == seq and p.startswith(f"case{case}.")}
                at = f"case{case}.{path}"
                if any(p.startswith(at + ".") or at.startswith(p + ".") or (p == at and (k == "scalar" or kind == "scalar")) for p, k in taken.items()):
                    continue  # one partial result is one tree
                rows.append((seq, case * 1000 + pos, at, kind, rng.choice("xyz")))
    kept = facts.drop_overwritten(frame(spark, rows))
    merged = facts.merge_facts(kept).collect()
    kept = kept.collect()
    kinds = {}
    for r in merged:
        kinds.setdefault(tuple(r.path), set()).add(r.kind)
    for path, own in kinds.items():
        assert len(own) == 1 and not any(path[:n] in kinds for n in range(1, len(path)))
    given = {}
    for seq, pos, path, kind, value in rows:
        given.setdefault(tuple(path.split(".")), []).append((seq, pos, kind, value))
    for path, own in kinds.items():
        mine = [x for x in given[path] if x[2] in own]
        if own == {"scalar"}:  # the last mention decides
            assert [r.value for r in merged if tuple(r.path) == path] == [max(mine)[3]]
        else:  # an item stands in the first kept partial result that has it, as often as there
            left = [(r.seq, r.pos, r.value) for r in kept if tuple(r.path) == path]
            assert {(r.seq, r.pos, r.value) for r in merged if tuple(r.path) == path} == {
                x for x in left if x[0] == min(y[0] for y in left if y[2] == x[2])}
    last = {}
    for path, all_rows in given.items():
        for n in range(1, len(path) + 1):
            last[path[:n]] = max(last.get(path[:n], ()), max(all_rows)[:1])
    assert all(any(p[:len(top)] == top for p in kinds) for top in {p[:1] for p in given})


def test_majority_and_note(spark):
    f = frame(spark, [(0, 0, "x", "scalar", "male"), (1, 0, "x", "scalar", "male"), (2, 0, "x", "scalar", "female"), (0, 1, "y", "scalar", "b"), (1, 1, "y", "scalar", "a")])
    resolved = facts.majority(f)
    assert {r.path[0]: r.value for r in resolved.collect()} == {"x": "male", "y": "a"}
    assert {r.path[0]: r.note for r in facts.discrepancies(resolved).collect()}["x"] == "x: kept male (2 of 3)"


REPLY = {"characters": {"Zoe": {"gender": "female", "aliases": "Z", "titles_held": ["Dame", ""], "speech_style": None}, "Al": {"gender": "male"}},
         "relationships": [{"from": "Zoe", "to": "Al", "address_term": "sir"}],
         "terminology": {"skills": {"heal": "mend"}, "items": {"sord": "sword"}}, "gender_fixes": ["watch Al"], "honorifics_policy": "keep"}


def test_flatten_and_pack(spark):
    replies = spark.createDataFrame([(0, json.dumps(REPLY)), (1, "nothing"), (2, '{"characters": {"Al": {"aliases": ["A", "B"]}}}')], "seq BIGINT, raw STRING")
    parsed = facts.parse_replies(replies)
    assert [r.failed for r in parsed.orderBy("seq").collect()] == [False, True, False]
    flat = facts.flatten_kb(parsed)
    assert flat.filter("seq = 1").isEmpty()
    lists = {(".".join(r.path), r.value) for r in flat.filter("kind = 'list'").collect()}
    assert {("characters.Zoe.aliases", "Z"), ("characters.Zoe.titles_held", "Dame"), ("characters.Al.aliases", "B")} <= lists
    merged = facts.merge_facts(flat)
    text = facts.pack_context(merged, 3500).first()["context"]
    assert text == (
        "=== CHARACTER & GRAMMAR BIBLE ===\n\n--- CHARACTERS ---\nZoe: female (unknown), titles: Dame, aliases: Z\n"
        "Al: male (unknown), aliases: A, B\n\n--- RELATIONSHIPS (how A addresses B) ---\n  Zoe → Al: \"sir\"\n"
        "\n--- TERMINOLOGY ---\n  [SKILLS]\n    heal → mend\n  [ITEMS]\n    sord → sword\n"
        "\n--- KNOWN GENDER ERRORS TO WATCH ---\n  • watch Al\n\n--- HONORIFICS POLICY ---\n  keep")
    assert facts.pack_context(merged, 50).first()["context"] == text[:50]
    counts = facts.kb_counts(merged).first()
    assert (counts.characters, counts.terms) == (2, 2)


def test_pack_context_limits_and_empty(spark):
    rows = [(0, i, "gender_fixes", "list", f"fix{i}") for i in range(30)]
    text = facts.pack_context(frame(spark, rows), 9999).first()["context"]
    assert text.count("•") == 10 and "fix9" in text and "fix10" not in text
    assert facts.pack_context(frame(spark, rows).limit(0), 99).first()["context"] == "=== CHARACTER & GRAMMAR BIBLE ===\n"


@pytest.mark.parametrize("tree", [
    {}, {"honorifics_policy": "k\"eep\n"}, {"characters": {"A": {"gender": "m", "aliases": ["x", "y"]}}, "gender_fixes": ["a"]},
    {"terminology": {"s": {"a": "b", "c": "d"}, "t": {"é": "ü"}}},
])
def test_kb_chars_is_json_length(spark, tree):
    rows = [(0, i, ".".join(p), k, v) for i, (p, k, v) in enumerate(leaves(tree))]
    df = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    assert facts.kb_chars(df).first()["kb_chars"] == len(json.dumps(tree, ensure_ascii=False, indent=2))


def test_kb_chars_of_objects(spark):
    items = [{"from": "A", "to": "B", "address_term": "sir"}, {"from": "C"}]
    tree = {"gender_fixes": ["x"], "relationships": items}
    rows = [(0, 0, "gender_fixes", "list", "x")] + [(0, 1 + i, "relationships", "list", json.dumps(o, separators=(",", ":"))) for i, o in enumerate(items)]
    assert facts.kb_chars(frame(spark, rows)).first()["kb_chars"] == len(json.dumps(tree, indent=2))


def test_synthesis_gate(spark):
    f = frame(spark, [(0, 0, "x.a", "scalar", "m"), (1, 0, "x.a", "scalar", "m"), (2, 0, "x.a", "scalar", "f")])
    got = {".".join(r.path): r.value for r in facts.synthesise(f).collect()}
    assert got == {"x.a": "m", "gender_fixes": "x.a: kept m (2 of 3)"}
    assert [r.value for r in facts.synthesise(f, limit=3).collect()] == ["f"]
