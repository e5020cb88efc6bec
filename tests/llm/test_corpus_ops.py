"""Operators on small fixtures with odd rows, against brute force in plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, exact_dedup, line_dedup, minhash, mixing, quality, substring_dedup

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, h1 long, anchor string, target double"
#: More names that operators use inside, as strings.
CLASHES = "__rid __tag __txt __row __share __cut __taken __size __rows __dropped source_key source_key__ share cut taken size n_rows cut lang_key kept comp id key n word bits t heavy_n a b row level name".split()


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def table(spark, rows):
    """A documents table with columns whose names operators use inside."""
    rng = random.Random(0)
    return spark.createDataFrame([(i, t, rng.choice(["en", "fr", None]), s, len(t) if t is not None else None, 1, 2, "x", 0.5) for i, t, s in rows], SCHEMA)


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    line = "This very common line of text stands in many documents"
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    texts = []
    for i in range(n):
        t = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))
        if i % 3 == 0:
            t += f"\n {line.upper() if i % 2 else line}\t"
        if i % 4 == 1:
            t += " " + passage
        texts.append(t)
    for i in range(0, n, 5):
        ws = texts[i].split(" ")
        if len(ws) > 20:
            ws[rng.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    texts += [texts[0], texts[0].replace(" ", "  "), "", None, " \n\t", "one", "one", "a b c", "x" * 9000, "x" * 9000, "é　b"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i * 7 - 50, t, ["a", "b", "c", None][i % 4] if i % 3 else "hot") for i, t in zip(ids, texts)]
    return rows + [(None, texts[1], "a"), rows[3], rows[3]]


@pytest.fixture(scope="module", params=[1000, 2], ids=["cold", "hot"])
def floor(request):
    """With a floor of 2 rows, what would be rare here is dealt with as hot keys."""
    old = common.heavy_keys.__defaults__
    common.heavy_keys.__defaults__ = (common.SHARE, request.param) if request.param > 2 else (40, 2)
    yield request.param
    common.heavy_keys.__defaults__ = old


def low(i):
    return common.NO_ID if i is None else i


def test_line_dedup(spark, floor):
    rows = corpus()
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    where = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                where[key(x)].add(low(i))
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(where.get(key(x), ())) >= 3 and low(i) < max(where[key(x)]))]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup(table(spark, rows)).collect()]
    assert Counter(got) == Counter(want) and sum(x[2] for x in want) > 20
    kept = line_dedup.filter_documents(table(spark, rows))
    assert kept.columns == table(spark, rows[:1]).columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((x[0], x[3]) for x in want)


def test_exact_dedup(spark, floor):
    rows = corpus()
    norm = lambda t: "".join(c for c in t or "" if c not in WS)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), low(i)))
    want = []
    for i, t, _ in rows:
        best = min(groups[norm(t)])[1]
        want.append((i, None if best == common.NO_ID else best, len(groups[norm(t)]), low(i) == best, hashlib.sha256(norm(t).encode()).hexdigest()))
    out = exact_dedup.groups(table(spark, rows), 30 if floor > 2 else 2048)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()) == Counter(want)


def components(rows, k, percent):
    sets = []
    for i, t, _ in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        sets.append((low(i), {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    comp = {i: i for i, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                x, y = root(sets[a][0]), root(sets[b][0])
                comp[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in sets]


def test_near_duplicates(spark, floor):
    k, percent = (4, 80) if floor > 2 else (2, 50)
    rows = corpus(3, 60)
    got = minhash.near_duplicates(table(spark, rows), k, percent).select(common.RID, "n_shingles", "comp").collect()
    assert Counter(map(tuple, got)) == Counter(components(rows, k, percent))
    kept = minhash.filter_documents(table(spark, rows), k=k, percent=percent)
    assert {low(r.doc_id) for r in kept.collect()} == {c for _, _, c in components(rows, k, percent)}


def test_near_duplicate_chain(spark):
    """A large group in which neighbours are linked and far ends are not."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([f"z{j}" if j < i else base[j] for j in range(100)]), "a") for i in range(0, 90, 3)]
    got = minhash.near_duplicates(table(spark, rows), 2, 80).select(common.RID, "n_shingles", "comp").collect()
    assert Counter(map(tuple, got)) == Counter(components(rows, 2, 80))


@pytest.mark.parametrize("common_n,extra", [(4, (0, 1)), (8, (1, 1)), (8, (0, 2)), (12, (1, 2))])
def test_estimates_of_small_sets(common_n, extra):
    """Of pairs of small sets at similarity 0.8 the estimate loses 1.3e-7, and minima agree like independent ones."""
    rng, least, lost, n = np.random.default_rng(5), minhash.least_estimate(80), 0, 40_000
    for _ in range(n):
        x = rng.integers(0, 2**64, common_n + sum(extra), dtype=np.uint64)
        a, b = x[: common_n + extra[0]], np.append(x[:common_n], x[common_n + extra[0] :])
        sig, other = (minhash.packed(minhash.minima(y)) for y in (a, b))
        lost += not minhash._alike(sig, len(a), other[None, :], np.array([len(b)]), 80, least)[0]
    assert lost == 0


@pytest.mark.parametrize("window,span,shard,floor", [(13, 5, 10**6, None), (5, 2, 50, None), (13, 5, 10**6, 2), (5, 2, 50, 1)])
def test_substring_dedup(spark, window, span, shard, floor):
    """With a floor of 1 or 2 segments, anchors are dealt with as heavy ones."""
    rows = corpus(5)
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            x = tuple(w[j : j + window])
            first[x] = min(first.get(x, low(i)), low(i))
    want = []
    for i, t, _ in rows:
        w = words(t)
        stay = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < low(i):
                stay[j : j + window] = [False] * window
        want.append((i, len(w), stay.count(False), " ".join(x for x, s in zip(w, stay) if s)))
    got = substring_dedup.dedup(table(spark, rows), window=window, span=span, shard=shard, floor=floor).collect()
    assert Counter(map(tuple, got)) == Counter(want) and sum(x[2] for x in want) > 100


def test_substring_dedup_of_runs(spark):
    """Documents that repeat one pair of words, whose windows are equal at many places."""
    rows = [(i, ("ab cd " * n) + f"tail{i} " * 3, "a") for i, n in enumerate((40, 7, 300, 2, 40))]
    first, want = {}, []
    for i, t, _ in rows:
        for j in range(len(words(t)) - 12):
            first.setdefault(tuple(words(t)[j : j + 13]), i)
    for i, t, _ in rows:
        w = words(t)
        gone = {j + d for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for d in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    for floor in (None, 1):
        got = substring_dedup.dedup(table(spark, rows), floor=floor).collect()
        assert Counter(map(tuple, got)) == Counter(want) and sum(x[2] for x in want) > 300


def test_quality_measures(spark):
    rows = corpus(7) + [(9999, "a b c a b c a b d " * 10, "a"), (9998, "one two\none two\n\n \none two\nx # $", "a")]
    want = []
    for i, t, _ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if x.strip(WS)]
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {j + d for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for d in range(3)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    out = quality.judge(table(spark, rows)).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert Counter(got) == Counter(want) and not any(r.kept and r.base_failed for r in out)


def test_quality_limits_follow_groups(spark):
    """What is usual in one source is kept there and rejected in another; small groups take their language's limits."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda mark: " ".join(word() + mark for _ in range(80))
    rows = [(i, text("##"), "marked") for i in range(150)] + [(i, text(""), "plain") for i in range(200, 400)] + [(500, text("##"), "plain"), (501, text("##"), "tiny"), (502, text(""), "tiny")]
    df = table(spark, rows).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert got[5] and got[300] and not got[500] and got[502]
    assert quality.filter_documents(df).count() == sum(got.values())


def test_quality_limits_of_rare_values_and_junk(spark):
    """Repetition far beyond what is usual is rejected, and a junk-heavy source cannot lift its own limit."""
    rng = random.Random(2)
    some = lambda n, mark="": " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + mark for _ in range(n))

    def lines(n, again):
        x = [some(12) for _ in range(n)]
        return "\n".join(x + x[:again])

    rows = [(i, lines(30, 1) if i % 2 else some(100), "plain") for i in range(400)]
    rows += [(1000 + i, some(100, "##") if i < 60 else some(100), "junk") for i in range(120)]
    rows += [(2000, lines(8, 2), "plain"), (2001, lines(30, 1), "plain")]
    df = table(spark, rows).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not got[2000].base_failed and not got[2000].kept and got[2001].kept
    assert not any(got[1000 + i].kept for i in range(60)) and all(got[1060 + i].kept for i in range(60))
    assert all(got[i].kept for i in range(400))


def test_sketch_buckets(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 1000, 10**9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket_floor(F.col("v"))).collect()]
    assert got == [v if v < 128 else v >> (v.bit_length() - 7) << (v.bit_length() - 7) for v in values]


def targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        free -= set(over)
    return out


@pytest.mark.parametrize("case", ["many", "capped", "none"])
def test_mixing(spark, case):
    rows = {"many": corpus(9), "capped": [(1, "a " * 5, "s1"), (2, "b " * 1000, "s2"), (3, "c " * 2, None), (4, None, "s3"), (5, "d " * 700, "s2")], "none": [(1, None, "a"), (2, " ", None)]}[case]
    got = mixing.takings(table(spark, rows)).collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        s = None if r.source_key == "-" else r.source_key[1:]
        assert r.source_size == sizes[s] and (r.target or 0) == pytest.approx(want[s], rel=1e-9) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * mixing.LEAST_BLOCK
    again = mixing.takings(table(spark, rows).repartition(3)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    mixed = mixing.filter_documents(table(spark, rows))
    assert mixed.columns == SCHEMA.replace(",", "").split()[::2]
    assert sum(len(words(r.text)) for r in mixed.collect()) == pytest.approx(sum(taken.values()), abs=3)


@pytest.mark.parametrize("slots", [mixing.SLOTS, 4, 1])
def test_mixing_gives_rounded_targets(spark, slots):
    """Each source gives its rounded target whatever the block, sources far below a block included."""
    rows = corpus(9) + [(1000 + i, "w " * (1 + i % 9), f"site{i}") for i in range(60)] + [(2000, "v " * 5000, "large")]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = targets(sizes), Counter()
    for r in mixing.takings(table(spark, rows), slots=slots).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[None if r.source_key == "-" else r.source_key[1:]] += r.taken
    assert taken == Counter({s: int(x + 0.5) for s, x in want.items()})
    total, (_, _, parts) = sum(sizes.values()), mixing.mix(table(spark, rows), slots=slots)
    block = max(mixing.LEAST_BLOCK, -(-total // slots))
    assert all(0 <= r.slot < -(-total // block) and 0 < r.words <= block for r in parts.collect())


def plain_mix(spark, rows, slots):
    """(doc_id, taken, first slot, slots) of each row, by walking through points and streams one by one."""
    hashes = F.xxhash64(F.lit(mixing.SEED), common.RID, common.TAG)
    sizes = mixing.sizes_of(table(spark, rows)).select("*", hashes.alias("ord"), (F.pmod(F.xxhash64("source_key"), F.lit(2**20)) / 2**20).alias("within")).collect()
    of = Counter()
    for r in sizes:
        of[r.source_key] += r["size"]
    want = targets(Counter({None if k == "-" else k[1:]: n for k, n in of.items()}))
    goals = {k: want[None if k == "-" else k[1:]] or 0 for k in of}
    total = sum(of.values())
    block = max(mixing.LEAST_BLOCK, -(-total // slots))
    n_slots, keys, dealt = -(-total // block), sorted(k for k in of if goals[k] > 0), {k: [] for k in of}
    for i in range(n_slots):
        u, upto = (i + 0.5) * mixing.GOLDEN % 1, 0.0
        for k in keys:
            upto += goals[k] / sum(goals.values())
            if u < upto or k == keys[-1]:
                dealt[k].append(i)
                break
    out = []
    for k in of:
        goal, own, at = int(goals[k] + 0.5), sorted((r for r in sizes if r.source_key == k), key=lambda r: (r.ord, r[common.RID], r[common.TAG])), 0
        blocks = (goal - 1) // block + 1 if goal else 0
        for rank in range(len(dealt[k]), blocks):
            dealt[k].append(int((rank + own[0].within) / blocks * n_slots))
        for r in own:
            taken, seen = 0, set()
            for start in range(at, at + 3 * of[k], of[k]) if r["size"] else ():
                end = min(start + r["size"], goal)
                if start < end:
                    taken += end - start
                    seen |= {dealt[k][b] for b in range(start // block, (end - 1) // block + 1)}
            out.append((r.doc_id, taken, min(seen, default=None), len(seen)))
            at += r["size"]
    return Counter(out)


@pytest.mark.parametrize("slots", [mixing.SLOTS, 7])
def test_takings_equal_the_plain_walk(spark, slots, monkeypatch):
    rows = corpus(9) + [(3000 + i, "w " * (1 + 37 * i % 90), f"site{i % 7}") for i in range(120)]
    rows = list({r[0]: r for r in rows}.values())
    got = lambda: Counter((r.doc_id, r.taken, r.first_slot, r.n_slots) for r in mixing.takings(table(spark, rows), slots=slots).collect())
    first = got()
    assert first == plain_mix(spark, rows, slots)
    at = {r[0]: r[2] for r in first}
    order = [at[r.doc_id] for r in mixing.filter_documents(table(spark, rows), slots=slots).collect()]
    assert order == sorted(order)
    monkeypatch.setattr(mixing, "GOLDEN", 0.5)  # another schedule is another mix
    assert got() != first and got() == plain_mix(spark, rows, slots)


def test_schedule_spreads_sources(spark):
    """Any stretch of the mix holds sources nearly in proportion, and ranks count each source's slots."""
    goals = spark.createDataFrame([("=a", 1.0), ("=b", 2.0), ("=c", 5.0), ("=d", 0.0)], "source_key string, target double")
    slots = sorted(mixing.schedule(spark, goals, 20_000).collect(), key=lambda r: r.slot)
    assert [r.slot for r in slots] == list(range(20_000))
    for begin in (0, 777, 12_345):
        n = Counter(r.source_key for r in slots[begin : begin + 800])
        assert all(abs(n[s] - 100 * w) <= 6 for s, w in (("=a", 1), ("=b", 2), ("=c", 5))) and not n["=d"]
    for s in "abc":
        assert [r.rank for r in slots if r.source_key == f"={s}"] == list(range(sum(r.source_key == f"={s}" for r in slots)))


@pytest.mark.parametrize("op", [line_dedup.filter_documents, minhash.filter_documents, quality.filter_documents, mixing.filter_documents])
def test_clashing_names_come_back(spark, op):
    """Columns named like the operators' own keep their values."""
    docs = table(spark, corpus(2, 40)).drop("pos", "h1", "anchor", "target")
    names = list(dict.fromkeys(CLASHES))
    marked = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(c) for c in names))
    plain, got = op(docs).collect(), op(marked).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in plain)
    assert len(got) and all(r[c] == f"{c}:{r.doc_id or 0}" for r in got for c in names)


def boilerplate(n, own=40, shared=60, seed=1):
    rng = random.Random(seed)
    head = " ".join(f"s{i}" for i in range(shared))
    return [(i, head + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(own)), "a") for i in range(n)]


def test_boilerplate_takes_linear_time(spark):
    """Documents that share most of their words but are not alike: no links, and time in proportion."""
    import time

    took = []
    for n in (2_500, 10_000):
        df = spark.createDataFrame(boilerplate(n), "doc_id long, text string, source string")
        began = time.perf_counter()
        assert minhash.near_duplicates(df).where(F.col("comp") != F.col(common.RID)).count() == 0
        took.append(time.perf_counter() - began)
    assert took[1] < 6 * took[0]


def test_second_round_deals_clusters(spark):
    """Links that no forest proposed are found whatever blocks and strips a cluster is dealt to."""
    rows = corpus(3, 60)
    df = table(spark, rows)
    sigs = minhash.signatures(df, 2).where("n > 0").select(F.col(common.RID).alias("id"), "n", "sig").dropDuplicates(["id"])
    texts = df.select(common.row_id().alias("id"), common.text_of().alias("text")).dropDuplicates(["id"])
    sets = {r.id: r.text for r in texts.collect()}
    want = {i: c for i, _, c in components([(i, t, None) for i, t in sets.items()], 2, 50)}
    nothing = spark.createDataFrame([], "id long, comp long")
    clusters = sigs.select("id", F.lit(0).cast("long").alias("comp"))
    for block, strip in ((10**6, 10**6), (7, 20)):
        links = minhash._round2(sigs, nothing, clusters, texts, 2, 50, block, strip)
        got = dict(map(tuple, minhash.components(links).collect()))
        assert {i: got.get(i, i) for i in sets} == want


@pytest.mark.parametrize("op", [exact_dedup.groups, substring_dedup.dedup, line_dedup.filter_documents, minhash.filter_documents, quality.filter_documents, mixing.filter_documents])
def test_empty_tables(spark, op):
    assert op(table(spark, corpus()[:1]).limit(0)).count() == 0
