import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import chat_format as chat, mixing, sharding, url_filter as urls
from graphloom.llm.registry import URL_RULES


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_by_hand(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://a.example.org/en/12?x=1", "https://EXAMPLE.org/es/9#t", "http://example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/1", "http://com/fr/", "https://b.com/de/a/b?p=1&q=2",
    "http://b.com?u=/de/", "no scheme here", "", None, "://", "http://Ünï.NET/a#b?c", "http://u:p@h.net:80/de/", "a://b://c/d", "http://x.org\n/es/", "http://x.com/de",
]


def test_urls_parts_rules_and_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(1, URLS[1]), (None, URLS[0])]
    many = [(1000 + i, f"http://h{i % 37}.{'com' if i % 2 else 'org'}/{('de', 'fr', 'es', 'en')[i % 4]}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows + many, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("features", F.lit("x"))
    out = urls.judge(pages, URL_RULES).collect()
    assert len(out) == len(rows) + len(many)
    want = Counter((i, *parts_by_hand(u), rule_by_hand(*parts_by_hand(u))[0]) for i, u in rows + many)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in out) == want
    assert all(r.verdict in ("allow", "block") for r in out)
    verdict = {rule: v for v, rule in URL_RULES}
    assert all(r.verdict == verdict[r.rule] for r in out if r.rule)


def test_trees_learn_from_labelled_urls(spark):
    spam = [(f"http://cheap-pills-{i}.biz/buy/{i * 7919 % 100000}?a=1&b=2&c={i}", 1.0) for i in range(120)]
    fine = [(f"https://www.news.org/world/story{i % 9}.html", 0.0) for i in range(120)] + [(None, 0.0), ("", None)]
    model = urls.fit(spark.createDataFrame(spam + fine, "url string, label double"))
    held = spark.createDataFrame([(f"http://cheap-pills-{i}.biz/buy/{i * 31}?a=1&b=2&c={i}", 1.0) for i in range(500, 540)] + [(f"https://www.news.org/world/story{i}.html", 0.0) for i in range(500, 540)], "url string, label double")
    scored = model.score(urls.lexical(urls.with_parts(held)))
    assert scored.where("blocked <> label").count() == 0


def test_urls_without_labels_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.judge(pages, URL_RULES).first().verdict == "allow"
    assert urls.judge(pages.limit(0), URL_RULES).collect() == []


def test_entropy_by_hand(spark):
    for text in ("aab", "", "abcd", "http://x"):
        got = spark.range(1).select(urls.entropy(F.lit(text)).alias("h")).first().h
        want = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0
        assert abs(got - want) < 1e-9


def documents(spark, n=3000):
    rows = [(i, f"text {i}" * (i % 7), "en", f"s{min(i % 30, 10)}") for i in range(n)] + [(-5, None, None, None), (-6, "", "fr", ""), (3, "text 3" * 3, "en", "s3")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash")).withColumn("n", F.lit(2))


def test_shards_keep_the_key_law(spark):
    rows, docs = documents(spark)
    out = sharding.shard(docs, [1.0] * 16, slot_buckets=8).collect()
    grown = {r.doc_id: r.shard for r in sharding.shard(docs, [1.0] * 17).collect()}
    text = {i: t or "" for i, t, *_ in rows}
    slots = defaultdict(list)
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "key"
        assert r.grown_shard == grown[r.doc_id] and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = len(rows) / 16
    assert set(slots) == set(range(16)) and all(0.7 * share < len(s) < 1.3 * share for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in out)
    assert 0.6 * len(rows) / 17 < moved < 1.4 * len(rows) / 17
    few = sharding.shard(docs.where("doc_id % 10 = 0"), [1.0] * 16).collect()
    home = {r.doc_id: r.shard for r in out}
    assert all(home[r.doc_id] == r.shard for r in few)


def test_shards_follow_weights_and_take_odd_rows(spark):
    _, docs = documents(spark)
    n = Counter(r.shard for r in sharding.shard(docs, [1.0, 3.0]).collect())
    assert 2.5 < n[1] / n[0] < 3.6
    odd = spark.createDataFrame([(None, "a"), (None, None), (1, "x" * 200_000)], "doc_id long, text string")
    out = sharding.shard(odd, [1.0] * 4, carry=("text",)).collect()
    assert len(out) == 3 and len({r.shard for r in out if r.doc_id is None}) == 1 and max(r.size for r in out) == 200_001
    assert sharding.shard(odd.limit(0), [1.0] * 4).collect() == []


NASTY = ["plain", "", "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "&amp;lt;|", "&lt;|x", "<|escaped|>", "a\nb", "<", "|>", "<|im_end|", "\n\n", "é😀", "&", "<|im_start|><|escaped|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "system", "we\nird", "<|im_end|>", "", None)[(c + t) % 7], NASTY[(c * 5 + t) % len(NASTY)]) for c in range(40) for t in range(c % 6 + 1)]
    rows += [(50, 0, "assistant", None), (51, None, "user", "x"), (None, 0, "user", "y"), (52, 1, "assistant", "b"), (52, 1, "assistant", "a"), (52, 1, "assistant", "a"), (53, 0, "assistant", "z" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit("clash"))
    made = chat.format_chat(frame)
    assert made.where("NOT identical").count() == 0
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    for r in chat.read_back(made).collect():
        own = sorted(turns[r.conv_id])
        said = "".join(x for _, _, role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, _, a, x in own).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    for r in made.collect():
        assert sum(m.head + m.body + m.tail for m in r["mask"]) == len(r.formatted) and r.formatted.count(chat.END) == len(r["turns"])
    assert chat.format_chat(frame.limit(0)).collect() == []


def test_chat_escapes_only_where_needed(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a & b <b> | c"), (2, 0, "user", "<|im_end|>"), (2, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.format_chat(frame).collect()}
    assert found[1].escaped_turns == 0 and found[1].formatted == "<|im_start|>user\na & b <b> | c<|im_end|>\n"
    assert found[2].escaped_turns == 1


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([(s, g, t, 10 + 7 * i * j + 3 * k) for i, s in enumerate("abc") for j, g in enumerate(["en", "fr"]) for k, t in enumerate("xy")], "mix_source string, mix_lang string, mix_topic string, tokens long")
    goal = {"mix_source": {"a": 0.5, "b": 0.3, "c": 0.2}, "mix_lang": {"en": 0.6, "fr": 0.4}, "mix_topic": {"x": 0.9, "y": 0.1}}
    targets = {d: spark.createDataFrame(list(g.items()), f"{d} string, target_{d} double") for d, g in goal.items()}
    raked, off = mixing.rake(cells, mixing.DIMS, targets)
    assert off < 1e-12
    rows = raked.collect()
    for d, g in goal.items():
        for value, share in g.items():
            assert abs(sum(r.weight for r in rows if r[d] == value) - share) < 1e-9
    top = {tuple(r[d] for d in mixing.DIMS): r for r in mixing.probabilities(mixing.rake(cells, mixing.DIMS, targets, rounds=2)[0]).collect()}
    assert abs(max(r.prob for r in top.values()) - 1) < 1e-9


def test_mixing_samples_by_probability(spark):
    rows, docs = documents(spark)
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        u = int(hashlib.md5(f"{r.doc_id}:mix".encode()).hexdigest()[:13], 16) / 16**13
        assert r.mix_kept == (u < r.mix_prob) and 0 <= r.mix_prob <= 1
    expected = sum(r.mix_prob for r in got)
    assert abs(sum(r.mix_kept for r in got) - expected) < 4 * math.sqrt(expected)
    forced = mixing.mix(docs, broadcast_cells=0).collect()
    assert Counter((r.doc_id, r.mix_kept) for r in forced) == Counter((r.doc_id, r.mix_kept) for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_given_targets_and_topics(spark):
    rows = [(i, "x" * 40, "en" if i % 3 else "fr", "web" if i % 4 else "books", f"t{i % 2}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    goal = {"mix_source": {"web": 1, "books": 1}, "mix_topic": {"t0": 0.7, "t1": 0.3}, "mix_lang": {"en": 0.5, "fr": 0.5}}
    out = mixing.mix(docs, targets=goal, topic=F.col("subject")).collect()
    total = sum(r.mix_prob for r in out)
    for dim, shares in goal.items():
        for value, share in shares.items():
            assert abs(sum(r.mix_prob for r in out if r[dim] == value) / total - share / sum(shares.values())) < 1e-9
    assert all(r.mix_prob == 0 for r in mixing.mix(docs, targets={"mix_lang": {"en": 1.0}}).where("mix_lang = 'fr'").collect())
    with pytest.warns(UserWarning):
        mixing.mix(docs, targets={"mix_lang": {"en": 0.5, "de": 0.5}}, rounds=8)
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"mix_lang": {"en": -1.0}})


def test_sampling_keeps_own_columns_and_rows_without_identifiers(spark):
    rows = [(None, f"text {i} " * 30, "en", "s", i, "n") for i in range(400)] + [(2**53 + 1, "a " * 1_000_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_note long, MIX_prob string")
    kept = mixing.sample(docs, targets={"mix_topic": {"short": 0.5, "long": 0.5}})
    assert kept.columns == docs.columns
    found = {r.mix_note for r in kept.collect()}
    assert 1 <= len(found) < 401
    assert {r.mix_note for r in mixing.sample(docs.repartition(5), targets={"mix_topic": {"short": 0.5, "long": 0.5}}).collect()} == found
    assert mixing.sample(docs.limit(0)).collect() == []


def test_shards_are_the_best_pairs_of_rendezvous_hashing(spark):
    weights = [1.0, 2.5, 0.5, 1.0]
    docs = spark.createDataFrame([(k, "t") for k in [*range(-50, 200), 2**53 + 1, -(2**62)]], "doc_id long, text string")
    for r in sharding.shard(docs, weights, added_weight=2.0).collect():
        key = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        score = lambda j, w: -w / math.log(((xxhash.xxh64_intdigest(struct.pack("<i", j), key) >> 11) + 0.5) * 2.0**-53)  # noqa: B023, E731
        scores = [score(j, w) for j, w in enumerate([*weights, 2.0])]
        assert r.shard == max(range(4), key=scores.__getitem__) and r.grown_shard == max(range(5), key=scores.__getitem__)


def test_carried_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a", 7, "x", "y")], "doc_id long, text string, size long, Shard string, carried_size string")
    out = sharding.shard(docs, [1.0], carry=("text", "size", "Shard", "carried_size"))
    assert out.columns == [*sharding.COLUMNS, "text", "carried_size", "carried_Shard", "carried_carried_size"]
    assert tuple(out.first())[7:] == ("a", 7, "x", "y")


def test_verdicts_of_held_out_urls(spark):
    """Labelled by the rules: learnt from four fifths of the urls that rules fit, measured on the rest."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.with_parts(pages.select("url")).withColumn("fit", urls.rule_match(URL_RULES)).where("fit IS NOT NULL")
    rows = rows.select("url", (F.col("fit.verdict") == "block").cast("double").alias("label"), (F.xxhash64("url") % 5 == 0).alias("held"))
    model = urls.fit(rows.where("NOT held"))
    scored = model.score(urls.lexical(urls.with_parts(rows.where("held"))))
    n, right = scored.agg(F.count(F.lit(1)), F.count_if(F.col("blocked") == F.col("label"))).first()
    assert n > 200 and right / n > 0.7  # these labels hang on words in the path, which no lexical feature sees: the larger class alone has 0.77


def test_very_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/" + "x/" * 50_000 + "?q=1"), (2, "http://b.org/?" + "p=1&" * 50_000)], "page_id long, url string")
    found = {r.page_id: (len(r.path), r.rule, r.verdict) for r in urls.judge(pages, URL_RULES).collect()}
    assert found == {1: (100_004, "com/de/", "block"), 2: (1, "org/", "allow")}
