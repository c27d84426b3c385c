"""Divergence audit, token cache and turn repair against brute force, with nulls, repeats, long texts and hot keys."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from quarry.llm import divergence, token_cache, turn_repair

public_tokenizers = pytest.importorskip("public_tokenizers")


# ---- divergence


def divergences(rows, least, keep):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
        for of, source, found in terms:
            if of == lang:
                docs.update(set(found))
                counts[source].update(found)
        kept = sorted(t for t, n in docs.items() if n >= least)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            best = [(q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", best)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(items) if part == "pair" or k < keep}
    return out


def source_rows():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("Wort", "été", "x", "日本", "b-c", "don't") for b in "abcdefgh"]
    rows = []
    for i in range(300):
        source = "hot" if i % 3 else rng.choice(["s1", "s2", "S1", None, "ü"])
        text = None if i % 41 == 0 else "" if i % 43 == 0 else " ".join(rng.choice(words[: 20 + 7 * (i % 5)]) for _ in range(rng.randrange(1, 30)))
        rows.append((["de", "fr", None][i % 7 % 3], source, text))
    return [*rows, ("de", "no terms", "1 2 3"), ("xx", "a", "rare"), ("xx", "b", "other"), ("fr", "long", "lang " * 200_000), *[rows[1]] * 40]


def test_divergences_equal_brute_force(spark):
    rows = source_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = divergences(rows, 12, 6)
    assert {r[2] for r in want} == {"pair", "term"} and ("xx", "a", "pair", "b", 0, 1) in want
    got = divergence.audit(docs, least_docs=12, keep=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_parts_of_counts_add_up_in_a_shard(spark, monkeypatch):
    rows = source_rows()[:200]
    monkeypatch.setattr(divergence, "HELD", 5)
    batches = spark.createDataFrame(rows, "lang string, source string, text string").na.fill("").toArrow().to_batches(max_chunksize=7)
    groups = sorted({(a or "", b or "") for a, b, _ in rows})
    ids = {g: (len(g[0]), i) for i, g in enumerate(groups)}
    counted = list(divergence._counted(ids)(iter(batches)))
    assert len(counted) > 20
    small = [r for b in divergence._kept_terms(3)(iter(counted)) for r in b.to_pylist()]
    monkeypatch.undo()
    plain = [r for b in divergence._kept_terms(3)(divergence._counted(ids)(iter(batches))) for r in b.to_pylist()]
    key = lambda rows: sorted((r["lang"], r["term"], sorted(zip(r["groups"], r["counts"], strict=True))) for r in rows)
    assert key(small) == key(plain) and plain
    assert list(divergence._kept_terms(3)(iter([]))) == []


def test_audit_of_an_empty_table_and_of_other_columns(spark):
    fields = "lang string, source string, text string, item long, value string, rank string, term string, grp string, a int, b int, n int, v int, absent int"
    rows = [(*r, 1, *"xxxx", 1, 2, 3, 4, 5) for r in source_rows()]
    docs = spark.createDataFrame(rows, fields)
    assert {tuple(r) for r in divergence.audit(docs, 12, 6).collect()} == divergences([r[:3] for r in rows], 12, 6)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_too_many_groups_raise(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MAX_GROUPS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        divergence.audit(spark.createDataFrame(source_rows(), "lang string, source string, text string"))


# ---- token cache


def odd_texts():
    rng = random.Random(9)
    alphabet = ["a", "be", " ", "  ", "\n", "▁", "<s>", "</s>", "é", "日本", "😀", "\t", "ﬁ", "the", " The", ".", " ", "<0x0A>", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    return [*texts, "", " ", "  ", "   ", "▁", "▁▁ ", " a", "a ", "a  ", "x" * 5000, "the cat " * 3000, "  ".join(["of", "the"] * 500)]


def library_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_library_s(spark, tmp_path, name):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (None, None), (None, texts[3]), (2, texts[2]), (2, "another text of one id")]
    tokenizer = token_cache.Tokenizer.load(public_tokenizers.path(name))
    assert tokenizer.by_chunk == name.endswith(".model")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = token_cache.count_tokens(docs, tokenizer, str(tmp_path / "cache"), limit=100).collect()
    known = dict(zip(texts, library_counts(name, texts), strict=True)) | {None: 0, rows[-1][1]: library_counts(name, [rows[-1][1]])[0]}
    want = [(i, len((t or "").encode()), known[t], known[t] > 100) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_parts_of_a_long_text_add_up(monkeypatch):
    tokenizer = token_cache.Tokenizer.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t.replace("▁", " ") for t in odd_texts()]
    whole = library_counts("piece_bpe_32k.model", texts)
    for size in (1, 7, 50):
        monkeypatch.setattr(token_cache, "SPLIT", size)
        assert tokenizer.counter()(texts) == whole
    monkeypatch.setattr(token_cache, "REMEMBERED", 3)
    assert tokenizer.counter()(texts) == whole


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    cache, tokenizer = str(tmp_path / "cache"), token_cache.Tokenizer.load(public_tokenizers.path("piece_bpe_32k.model"))
    stored = lambda t: spark.read.parquet(f"{cache}/tokenizer={t.version}").count()
    run = lambda rows, t=tokenizer: sorted(map(tuple, token_cache.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), t, cache).collect()))
    hot = [(i, "one text that a third of all rows have") for i in range(60)] + [(7, "the same row")] * 60
    first = run([*hot, (100, "a"), (101, "b c"), (102, "b▁c")])
    # equal texts are one entry, and so are those that the model reads alike
    assert stored(tokenizer) == 4 and len(first) == 123
    assert run([*hot, (100, "a")]) == [r for r in first if r[0] < 101] and stored(tokenizer) == 4
    assert [r[2] for r in run([(1, "a"), (2, "new")])] == library_counts("piece_bpe_32k.model", ["a", "new"]) and stored(tokenizer) == 5
    other = token_cache.Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert run([(1, "b c")], other)[0][2] == library_counts("byte_bpe_50k.json", ["b c"])[0]
    assert stored(other) == 1 and stored(tokenizer) == 5
    # what is stored is what is told: an entry counts, whoever wrote it
    spark.createDataFrame([(hashlib.sha256(b"planted").digest(), 77)], "digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/tokenizer={tokenizer.version}")
    assert run([(1, "planted")])[0][2] == 77


def test_other_columns_pass_through_and_empty_tables_are_taken(spark, tmp_path):
    names = "row own_key digest content lacking of_key n_tokens over_limit".split()
    docs = spark.createDataFrame([(i, f"t {i % 3}", *(f"{c}-{i}" for c in names)) for i in range(9)], "doc_id long, text string" + "".join(f", {c} string" for c in names))
    tokenizer = token_cache.Tokenizer.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = token_cache.count_tokens(docs, tokenizer, str(tmp_path / "cache")).collect()
    assert len(got) == 9 and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in names[:6]) and {r["n_tokens"] for r in got} == {library_counts("piece_bpe_32k.model", ["t 1"])[0]}
    assert token_cache.count_tokens(docs.limit(0), tokenizer, str(tmp_path / "cache")).count() == 0


# ---- turn repair


def cheapest(turns):
    """Dijkstra over (cost, edits): turns of (initial, must go, truncated)."""
    moves = {0: "s1u2", 1: "u2", 2: "a3", 3: "u2"}
    step = {s: {m[i]: int(m[i + 1]) for i in range(0, len(m), 2)} for s, m in moves.items()}
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, edits, i, s = heapq.heappop(queue)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(turns) and s in (0, 3):
            return cost, edits
        for r, to in step[s].items():
            if r in "ua":
                heapq.heappush(queue, (cost + 3, edits + "I", i, to))
        if i < len(turns):
            initial, goes, cut = turns[i]
            heapq.heappush(queue, (cost + 4, edits + "D", i + 1, s))
            if not goes:
                if initial in step[s]:
                    heapq.heappush(queue, (cost + 3 * cut, edits + "K", i + 1, step[s][initial]))
                for r, to in step[s].items():
                    if r in "ua":
                        heapq.heappush(queue, (cost + 3 + 3 * cut, edits + "R", i + 1, to))
    raise AssertionError


def code(turn):
    return ".sua".index(turn[0]) * 4 + (1 if turn[1] else 3 if turn[2] else 0)


def test_repairs_equal_dijkstra_for_all_short_conversations():
    kinds = [(r, False, cut) for r in "sua." for cut in (0, 1)] + [("u", True, 0)]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert turn_repair.repair(bytes(map(code, turns))) == cheapest(turns), turns


def test_repairs_equal_dijkstra_for_long_conversations(monkeypatch):
    rng = random.Random(2)
    for stride in (4096, 3):
        monkeypatch.setattr(turn_repair, "STRIDE", stride)
        for _ in range(250):
            weights = [rng.random() for _ in range(4)]
            turns = [(rng.choices("sua.", weights)[0], rng.random() < 0.1, int(rng.random() < 0.15)) for _ in range(rng.randrange(60))]
            assert turn_repair.repair(bytes(map(code, turns))) == cheapest(turns)


def test_a_very_long_conversation_is_repaired_in_linear_time():
    rng = random.Random(1)
    cost, edits = turn_repair.repair(bytes(rng.randrange(16) for _ in range(300_000)))
    assert sum(e in "DKR" for e in edits) == 300_000 and cost > 300_000


def brute(rows):
    """The report of rows (conv_id, turn, role, text)."""
    out = {}
    space = lambda x: " " if x is None else x
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, kept = space(role), space(text), by_conv[conv]
        draw = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        kept += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for conv, kept in by_conv.items():
        kept.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        counts, turns, seen = collections.Counter(), [], set()
        for _, role, text in kept:
            visible = text.rstrip("\t\n\x0b\x0c\r ")
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role[:1] if role[:1] in ("s", "u", "a") else ".", fault in ("blank", "duplicate"), int(fault == "truncated")))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(kept, kept[1:], strict=False))
        cost, edits = cheapest(turns)
        lines, state, rest = [], 0, list(kept)
        for e in edits:
            given = "assistant" if state == 2 else "user"
            if e == "I":
                lines.append(f"{given}:")
            else:
                _, role, text = rest.pop(0)
                if e != "D":
                    lines.append(f"{given if e == 'R' else role}:{text}")
            if e != "D":
                state = {"s": 1, "u": 2, "a": 3}[lines[-1][0]]
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def conversation_rows():
    rng = random.Random(5)
    texts = ["Hello there.", "What?", "cut off", " \t", "", None, "Yes!  ", "é.", "a.b!c", "No\x0b"]
    rows = [(i % 90, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "úser"]), rng.choice(texts)) for i in range(700)]
    rows += [(900, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(400)]  # a conversation with a third of all rows
    rows += [(None, 1, "user", "Null conversation."), (901, None, "user", "Long. " * 100_000)]
    return rows + rows[:30]


def test_reports_equal_brute_force(spark):
    rows = conversation_rows()
    turns = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, place string, code int, dropped boolean").repartition(5)
    report, marked = turn_repair.diagnose(turn_repair.damaged(turns))
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in turn_repair.repaired_hashes(report, marked).collect()}
    want = brute(rows)
    got = report.collect()
    assert len(got) == len(hashes) == len(want)
    for r in got:
        assert (*r[1:], hashes[r["conv_id"]]) == want[r["conv_id"]][:-1], r
    lines = collections.defaultdict(list)
    for r in sorted(turn_repair.repaired_turns(report, marked).collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: x for c, x in lines.items()} == {c: w[-1] for c, w in want.items() if w[-1]}
    assert any(not w[-1] for w in want.values())


def test_dropped_conversations_have_zeros_and_empty_tables_no_report(spark):
    turns = spark.createDataFrame([(i, 0, "user", "Hi.") for i in range(60)], "conv_id int, turn int, role string, text string")
    report, marked = turn_repair.diagnose(turn_repair.damaged(turns))
    gone = [i for i in range(60) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    rows = {r["conv_id"]: r for r in report.collect()}
    assert gone and len(rows) == 60 and all(tuple(rows[i])[1:] == (0, 0, 0, 0, 0, 0, "") for i in gone)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in turn_repair.repaired_hashes(report, marked).collect()}
    assert all(hashes[i] == hashlib.sha256(b"").hexdigest() for i in gone)
    report, marked = turn_repair.diagnose(turn_repair.damaged(turns.limit(0)))
    assert report.count() == turn_repair.repaired_hashes(report, marked).count() == 0
