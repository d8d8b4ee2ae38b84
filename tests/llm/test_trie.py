import hashlib
import random
import zlib

import pytest

from tablelens.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt, turn_id
from tablelens.llm.queries import QUERIES, SQL
from tablelens.llm.radix_tree import Direct, Indexed, RadixTree, Sorted, common

COLUMNS = "conv_id long, turn long, role string, text string, conv string, depth string, key string, first string"


def test_tree_keeps_all_keys_and_grows_through_its_layouts():
    pick = random.Random(4)
    keys = {bytes(pick.choice(b"\x00\x01\xff") for _ in range(pick.randint(0, 6))) for _ in range(400)}
    keys |= {bytes([a]) + b"xyz" * 5 for a in range(256)} | {b"q" + bytes([a]) for a in range(40)} | {b"r" + bytes([a]) for a in range(12)} | {b"s" + bytes([a]) for a in range(3)}
    tree = RadixTree()
    order = sorted(keys)
    pick.shuffle(order)
    for n, key in enumerate(order):
        tree.put(key, n)
    assert all(tree.get(k) == n for n, k in enumerate(order))
    assert tree.get(b"none of them") is None and tree.get(b"xy") is None
    layouts = {type(node.layout).__name__ + str(node.layout.room) for node, *_ in tree.bottom_up() if node.layout}
    assert layouts == {Sorted.__name__ + "4", Sorted.__name__ + "16", Indexed.__name__ + "48", Direct.__name__ + "256"}
    depths = {id(node): end for node, _, _, end in tree.bottom_up()}
    assert all(begin == (depths[id(above)] if above else 0) for _, above, begin, _ in tree.bottom_up())
    assert sorted(n.value for n, *_ in tree.bottom_up() if n.value is not None) == list(range(len(order)))
    assert RadixTree().get(b"") is None and common(b"abc", b"abd") == 2 and common(b"", b"a") == 0


def plain_trie(rows):
    """By dictionaries of prefixes."""
    def ident(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, ident(role, text), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, children, ends = {}, {}, {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
            if d:
                children.setdefault(t[: d - 1], set()).add(t[:d])
        ends.setdefault(t, []).append(c)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
    return [
        (min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children.get(path, ())), leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, who in members.items()
    ]


def conversations(seed):
    pick = random.Random(seed)
    said = [(pick.choice(["user", "assistant", None, ""]), pick.choice(["", None, "é" * 3, "a" * pick.randint(1, 9), "😀b"])) for _ in range(12)]
    rows = []
    for c in [*range(0, 260), *range(-130, -90), -7, 1_000, 1_001, 4_050, 10**12]:
        many = 0 if c == 200 else pick.randint(1, 8) if c % 3 else 4
        for t in range(many):
            rows.append((c, None if pick.random() < 0.05 else t, *(said[t] if c % 3 == 0 or pick.random() < 0.8 else pick.choice(said))))
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (5, 0, "user", "more"), (None, 0, "user", "lost"), (77_777, 0, "user", "long" * 20_000)]
    rows += [(88_000, t, "user", f"t{t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("turns", [200_000, 60])
def test_trie_as_by_hand(spark, turns):
    rows = conversations(turns)
    frame = spark.createDataFrame([(*r, "c", "d", "k", "f") for r in rows], COLUMNS).repartition(7)
    out = prefix_trie(rebuilt(ordered_turns(frame)), turns=turns)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)


def test_copies_and_one_path_over_many_ranges(spark):
    """A third of all conversations alike, and prefixes of one another: every range begins and ends inside the same path."""
    rows = [(c, t, "user", f"t{t}") for c in range(1, 400) for t in range(6 if c % 3 == 0 else c % 40)] + [(c, 0, "user", "other") for c in range(1_000, 1_020)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    got = [tuple(r) for r in prefix_trie(rebuilt(ordered_turns(frame)), turns=100).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)


def test_no_conversation_has_no_root(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(rebuilt(ordered_turns(empty))).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], empty.schema)
    assert prefix_trie(rebuilt(ordered_turns(nobody))).count() == 0


def test_a_conversation_without_turns_is_at_the_root(spark):
    number = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    frame = spark.createDataFrame([(number, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in prefix_trie(rebuilt(ordered_turns(frame))).collect()] == [(number, 0, None, 1, 0, 1, 0, hashlib.sha256(str(number).encode()).hexdigest())]


def test_ids_keep_role_and_text_apart(spark):
    frame = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", "abc")], "role string, text string")
    assert frame.select(turn_id(frame.role, frame.text).alias("id")).distinct().count() == 3


def test_query_agrees_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create view conversations as select * from read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    want = con.execute(SQL["op12_prefix_trie"]).fetchall()
    assert sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01").collect()), key=repr) == sorted(want, key=repr)
