"""Hand-written source, entities, packing, mixing and abusive content."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import abuse, entities, packing
from codeloom.llm.handwritten import find_foreign
from codeloom.llm.repair import abstract, concrete, grammar_stats, phrases, tokens

# --- problem 1 ---


def code(seed, n=12):
    r = random.Random(seed)
    w = lambda: "".join(r.choices("abcdefghij", k=6))
    parts = [f"function {w()}({w()}) {{\n  const {w()} = {w()}.{w()}({r.randint(1, 99)});\n" + "".join(r.choice([f"  if ({w()} > {r.randint(0, 9)}) {{ return {w()}; }}\n", f"  {w()}({w()}, '{w()}');\n", f"  for (const {w()} of {w()}) {{ {w()}(); }}\n"]) for _ in range(r.randint(1, 6))) + "}\n" for _ in range(n)]
    return "\n".join(parts)


def test_grammar_of_repeats_is_small():
    gen = "".join(f"  get_x{k}() {{ return this.d[{k}]; }}\n" for k in range(200))
    a, b = grammar_stats([abstract(tokens(gen)), abstract(tokens(code(1, 60)))])
    assert a["size"] + 2 * a["rules"] < 90 < 200 < b["size"] + 2 * b["rules"]
    assert grammar_stats([np.empty(0, np.uint64)])[0]["size"] == 0


def test_phrases_are_local():
    x, y = concrete(tokens(code(2))), concrete(tokens("let other = 1;\n" + code(2) + "\nlet more = 2;"))
    px, lx = phrases(x, 4)
    py, _ = phrases(y, 4)
    assert lx[np.isin(px, py)].sum() > 0.7 * lx.sum() and lx.sum() == len(x)
    assert not np.isin(phrases(concrete(tokens(code(3))), 4)[0], py).any()


def test_foreign_files(spark):
    gen = "class A {\n" + "".join(f"  get_x{k}() {{ return this.d[{k}]; }}\n" for k in range(40)) + "}"
    data = "export const T = [\n" + ",\n".join(str([random.Random(k).random() for _ in range(6)]) for k in range(60)) + "];"
    small = "var a=function(b){" + "return b>1?b.c(b+2):b;" * 60 + "}"
    rows = [(1, "g1", "a.js", code(1)), (2, "g1", "b.ts", gen), (3, "g2", "c.js", data), (4, "g2", "d.JS", small), (5, "g1", "v/e.js", code(5)), (6, "g2", "x/f.js", "// other\n" + code(5)), (7, "g1", "h.js", code(7)), (8, "g1", "i.js", code(7)), (9, "g1", "j.txt", gen), (10, "g1", "k.py", None), (11, "g1", "l.py", ""), (2, "g1", "./b.ts", gen)]
    f = spark.createDataFrame([(i, f"/srv/scan/{g}/r", p, c, "x") for i, g, p, c in rows], "fileId bigint, repoRoot string, relPath string, content string, kind string")
    assert {r["file_id"]: r["kind"] for r in find_foreign(f).collect()} == {2: "tool", 3: "data", 4: "squeezed", 5: "copy", 6: "copy"}
    assert find_foreign(f.limit(0)).count() == 0


# --- problem 2 ---


def test_entities(spark):
    rows = [
        ("a1", "Anna Kovberg", "anna.kovberg@x.test", None), ("a2", "KOVBERG, Anna", "akovberg@x.test", ["12300+akovberg@users.noreply.codehost.example"]), ("a3", "anna.kovberg", None, ["annakovberg12300@mailbox.example"]), ("a4", "A. Kovberg", "<ANNA.KOVBERG+git@x.test>", []),
        ("b1", "Anna Kovberg", "anna.kovberg@y.test", None), ("c1", "Anja Kovberg", "anja.kovberg@x.test", None), ("d1", "Müge Torsen", "muege.torsen@x.test", None), ("d2", "Muge Torsen", "mtorsen@x.test", None),
        ("o1", "Zelmar Systems GmbH", "dev@zelmar.y.test", None), ("o2", "zelmar-bot", "bot-zelmar@y.test", None), ("n1", None, None, None), ("n2", "", "", None), ("a1", "Anna Kovberg", "anna.kovberg@x.test", ["akovberg@x.test"]),
    ]
    df = spark.createDataFrame([(*r, "e") for r in rows], "id string, name string, email string, aliases array<string>, entity string")
    ent = entities.resolve(df)
    groups: dict = {}
    for r in ent.collect():
        groups.setdefault(r["entity"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [["a1", "a2", "a3", "a4"], ["b1"], ["c1"], ["d1", "d2"], ["n1"], ["n2"], ["o1", "o2"]]
    assert entities.pairs(ent).count() == 6 + 1 + 1
    assert entities.resolve(df.limit(0)).count() == 0


def test_entities_of_a_large_organisation(spark):
    word = lambda k: "".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in f"{k:03d}")
    rows = [r for k in range(0, 300, 7) for r in ((f"p{k:03d}a", f"Maria {word(k)}", f"maria.{word(k)}@big.test", None), (f"p{k:03d}b", f"M. {word(k)}", f"m{word(k)}@big.test", None))]
    rows += [("x1", "Anna Kovberg", "anna.kovberg@big.test", ["11100+a@users.noreply.codehost.example"]), ("x2", "Anna Kovberg", "a.kovberg@big.test", ["22200+b@users.noreply.codehost.example"]), ("x0", "Anna Kovberg", "akovberg@big.test", None)]
    rows += [(f"f{k}", "Jo Lindmann", f"jolindmann{k}000{k}@post.test", None) for k in range(3)]
    got = {frozenset(r) for r in entities.pairs(entities.resolve(spark.createDataFrame(rows, "id string, name string, email string, aliases array<string>"))).collect()}
    assert got == {frozenset((f"p{k:03d}a", f"p{k:03d}b")) for k in range(0, 300, 7)}  # nobody of a free-mail host, and not two numbered people through a third


def test_components_equal_brute_force(spark):
    random.seed(2)
    links = [(f"k{random.randrange(60)}", f"n{random.randrange(80):02d}") for _ in range(90)]
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(80)], "node string")
    got = {r["node"]: r["comp"] for r in entities._components(nodes, spark.createDataFrame(links, "key string, node string")).collect()}
    root = {f"n{k:02d}": f"n{k:02d}" for k in range(80)}
    for _ in range(80):
        for k in {k for k, _ in links}:
            members = [n for kk, n in links if kk == k]
            low = min(root[m] for m in members)
            for m in members:
                root[m] = low
    assert got == root


@pytest.mark.parametrize("a, b, want", [("torsky", "torsky", True), ("torsky", "tosrky", True), ("torsky", "torskyy", True), ("torsky", "torky", True), ("torsky", "tarski", False), ("ab", "ac", False)])
def test_near(a, b, want):
    assert entities.near(a, b) == want


# --- problems 6 and 7 ---


def test_pack_shard_limits():
    r = np.random.default_rng(4)
    n = r.integers(1, 1500, 800)
    loss = (n * r.random(800)).astype(int)
    rows = packing.pack_shard(np.arange(800), n, loss, 1024, 12, 700)
    by: dict = {}
    for d, part, tok, x, c in rows:
        b = by.setdefault(c, [0, 0, 0, []])
        b[0], b[1], b[2] = b[0] + tok, b[1] + 1, b[2] + x
        b[3].append(x)
    assert all(t <= 1024 and s <= 12 for t, s, _, _ in by.values())
    # a whole text above the loss limit is alone with its true count: nothing else there bears loss
    assert all(x <= 700 or max(each) == x and max(each) <= 1024 for _, _, x, each in by.values())
    got, bore = {}, {}
    for d, _, tok, x, _ in rows:
        got[d], bore[d] = got.get(d, 0) + tok, bore.get(d, 0) + x
    assert got == dict(enumerate(n.tolist())) and bore == dict(enumerate(loss.tolist()))  # whole, no count cut
    parts = {d for d, part, *_ in rows if part}
    assert parts == {k for k, v in enumerate(n) if v > 1024}  # split only where longer
    assert packing.pack_shard(np.empty(0, int), np.empty(0, int), np.empty(0, int), 10, 2, 10) == []


@pytest.mark.parametrize("n, loss, segments, loss_cap, full", [([60] * 40, [0] * 40, 100, 100, (120, 2, 0)), ([10] * 40, [0] * 40, 4, 100, (40, 4, 0)), ([30] * 40, [30] * 40, 100, 60, (60, 2, 60))])
def test_each_limit_binds(n, loss, segments, loss_cap, full):
    by: dict = {}
    for _, _, tok, x, c in packing.pack_shard(np.arange(40), np.array(n), np.array(loss), 128, segments, loss_cap):
        b = by.setdefault(c, [0, 0, 0])
        b[0], b[1], b[2] = b[0] + tok, b[1] + 1, b[2] + x
    assert {tuple(b) for b in by.values()} == {full}


def test_dot_product_equals_brute_force():
    r = np.random.default_rng(8)
    n = r.integers(1, 90, 60)
    x = (n * r.choice([0, 0.5, 1], 60)).astype(int)
    rows = packing.pack_shard(np.arange(60), n, x, 100, 5, 70)
    left = {(int(a), int(b)): 0 for a, b in zip(n, x)}
    for a, b in zip(n, x):
        left[(int(a), int(b))] += 1
    heavy = {c for _, _, _, b, c in rows if b > 70}
    room, at = None, -1
    for _, _, a, b, c in rows:
        if c != at:
            room, at = [100, 5, 70], c
        if not (c in heavy and room[1] == 5):
            dot = {k: k[0] * room[0] / 1e4 + k[1] * room[2] / 4900 for k, v in left.items() if v and k[0] <= room[0] and k[1] <= room[2]}
            assert dot[(a, b)] == pytest.approx(max(dot.values()))
        left[(a, b)] -= 1
        room = [room[0] - a, room[1] - 1, max(0, room[2] - b)]
    assert not any(left.values())


def docs(spark):
    rows = [(k, "word " * (5 + k % 50), "A" if k % 3 else "b", 1) for k in range(600)] + [(900, None, "a", 1), (901, "", "a", 1), (902, "```\ncode\n```\nshown", None, 1), (903, "long " * 3000, "c", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")


def test_pack(spark):
    counts = packing.token_counts(docs(spark))
    assert counts.where("doc_id IN (900, 901)").count() == 0
    code_doc = counts.where("doc_id = 902").first()
    assert 0 < code_doc["loss_tokens"] < code_doc["tokens"]
    specs = spark.createDataFrame([("s", 128), ("s", 128), ("none", 0)], "spec_name string, capacity_tokens int")
    packed = packing.pack(counts, specs)
    total = counts.agg(F.sum("tokens")).first()[0]
    assert packed.agg(F.sum("tokens")).first()[0] == total
    f = packing.fills(packed, specs).agg(F.max("fill"), F.avg("fill")).first()
    assert f[0] <= 1 and f[1] > 0.95
    assert packing.pack(counts.limit(0), specs).count() == 0


def test_mix(spark):
    counts = packing.token_counts(docs(spark))
    goals = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 3), ("m", "nowhere", 0.1, 2)], "mix_name string, source string, weight double, max_repeats int")
    chosen = packing.mix(counts, goals)
    assert chosen.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0
    assert chosen.where("source = 'a'").agg(F.max("repeats")).first()[0] == 1 and chosen.where("source = 'b'").agg(F.max("repeats")).first()[0] <= 3
    s = {r["source"]: r["share"] for r in packing.shares(chosen, goals).collect()}
    assert abs(s["a"] - 0.5) < 0.02 and abs(s["b"] - 0.5) < 0.02 and s["nowhere"] == 0
    assert packing.mix(counts, goals.limit(0)).count() == 0


def test_temperature():
    p, size, a = packing.temperature_weights({"x": 0.9, "y": 0.1}, {"x": 100.0, "y": 1000.0}, {"x": 2.0, "y": 1.0})
    assert a == pytest.approx(0, abs=1e-9) and size == pytest.approx(200 / 0.9) and p["x"] == pytest.approx(0.9)
    p, size, a = packing.temperature_weights({"x": 0.9, "y": 0.1}, {"x": 100.0, "y": 1000.0}, {"x": 2.0, "y": 1.0}, 600.0)
    assert 0 < a < 1 and p["x"] * size <= 200.001 and p["x"] * size > 199
    assert packing.temperature_weights({"x": 1.0}, {}, {"x": 1.0}) == ({}, 0.0, 0.0)


def test_exponent_by_tolerance_and_entropy():
    w, sizes, limits = {"x": 0.5, "y": 0.3, "z": 0.2}, {"x": 100.0, "y": 1000.0, "z": 4000.0}, {"x": 2.0, "y": 1.0, "z": 1.0}
    p, size, a = packing.temperature_weights(w, sizes, limits, tolerance=0.01)
    assert 0 < a < 1 and max(abs(p[s] - w[s]) for s in w) == pytest.approx(0.01, abs=1e-6) and size > 200 / 0.5
    h = lambda p: -sum(v * np.log(v) for v in p.values())
    p, size, a = packing.temperature_weights(w, sizes, limits, entropy=0.8)
    assert 0 < a < 1 and h(p) == pytest.approx(0.8, abs=1e-6) and all(p[s] * size <= limits[s] * sizes[s] * 1.0001 for s in p)


def test_nearest_and_repeats():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = r.integers(5, 60, 12).astype(float)
        goal = float(r.integers(20, 300))
        sums = [float(sizes[[bool(k >> i & 1) for i in range(12)]].sum()) for k in range(1 << 12)]
        assert abs(sizes[packing.nearest(sizes, goal)].sum() - goal) <= min(abs(x - goal) for x in sums) + 3
    assert packing.nearest(np.array([10.0]), 6.0).tolist() == [True] and packing.nearest(np.array([10.0]), 4.0).tolist() == [False]
    assert packing.repeats(np.array([10.0, 30.0]), 70.0, 4, 1.0).tolist() == [3, 1] or packing.repeats(np.array([10.0, 30.0]), 70.0, 4, 1.0) @ [10, 30] == 70


def test_mix_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(packing, "BLOCK_GROUPS", 8)
    r = random.Random(4)
    counts = spark.createDataFrame([(k, "ab"[k % 3 == 0], r.randint(5, 90)) for k in range(3000)], "doc_id bigint, source string, tokens bigint")
    goals = spark.createDataFrame([("m", "a", 0.8, 1), ("m", "b", 0.2, 3), ("n", "b", 1.0, 2)], "mix_name string, source string, weight double, max_repeats int")
    chosen = packing.mix(counts, goals, budget=20_000.0)
    got = {(x["mix_name"], x["source"]): x["t"] for x in chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()}
    assert all(abs(got[k] - goal) <= packing.TOLERANCE * 20_000 / 4 for k, goal in {("m", "a"): 16_000, ("m", "b"): 4_000, ("n", "b"): 20_000}.items())
    assert chosen.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0


# --- problem 8 ---

BAD = ["You are a total m0ron, reviewer 2.", "Kill yourself, @bob.", "Shut up, i-d-i-o-t, nobody asked you.", "Women are vermin and should never be allowed near a compiler.", "Show me your t*ts on the next call.", "Du bist so ein Vollidiot, my friend.", "Ferme ta gueule, espèce d'abruti."]
FINE = ["Kill the child process before the parent.", 'The word list holds terms such as "moron".', "This hack is stupid and ugly, let us delete the garbage.", "Damn, the build fails again.", "Your idiot-proof guide saved my day, thank you.", "The report moved to the archive folder.", "Refugees and citizens share one form."]


def test_features_tell_passages():
    kinds = abuse.FEATURES.index("kinds")
    assert min(abuse.features(t)[kinds] for t in BAD) > max(abuse.features(t)[kinds] for t in FINE)
    assert abuse.features(None) == abuse.features("") and len(abuse.features("x")) == len(abuse.FEATURES)
    assert abuse.features("fine. " * 20000 + BAD[0])[kinds] >= 1  # whole texts


def test_densities():
    one, two = (dict(zip(abuse.FEATURES, abuse.features(t))) for t in ("You idiot.", "You idiot. " + "Plain words follow here and say nothing at all. " * 9))
    assert one["insult"] == two["insult"] > 0 and one["text_insult"] > 9 * two["text_insult"] > 0 and one["share"] == 1 > two["share"]


@pytest.mark.parametrize("shown, meant", [("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("a*****e", "asshole"), ("pirck", "prick"), ("biiitch", "bitch"), ("plain words", "plain words")])
def test_reveal(shown, meant):
    assert abuse.reveal(shown)[0] == meant


def test_score_on_held_out(spark):
    r = random.Random(7)
    rows = [(k, " ".join([*r.sample(FINE, 3), *([r.choice(BAD)] if k % 4 == 0 else [])]), ["a", None][k % 2]) for k in range(400)] + [(1000, None, "a"), (1001, "", "b")]
    d = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(k, f"r{j}", int((k % 4 == 0) != (r.random() < 0.06))) for k in range(200) for j in range(1 + k % 2)], "doc_id bigint, rater string, abusive int")
    s = abuse.score(d, labels)
    got = {x["doc_id"]: x["score"] for x in s.collect()}
    assert len(got) == 402
    held = [(got[k] >= abuse.THRESHOLD) == (k % 4 == 0) for k in range(200, 400)]
    assert sum(held) / len(held) > 0.97
    assert abuse.rates(s).where("source = '(none)'").first()["documents"] == 200
    assert abuse.score(d, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0  # no ratings, no scores
    assert abuse.score(d.limit(0), labels).count() == 0
