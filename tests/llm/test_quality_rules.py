import collections
import re
import unicodedata

from pyspark.sql import functions as F

from ledgerlens.llm import quality_rules as q

SF = "/root/testdata/sf0.001"


def plain(text):
    """The measurements of one text, the long way."""
    t = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", t)
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i: i + 3])].append(i)
    repeated = {i + j for found in at.values() if len(found) > 1 for i in found for j in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    letters = [c for c in t if unicodedata.category(c)[0] in "LM"]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in q.SYMBOLS for c in t), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_upper": sum(unicodedata.category(c) == "Lu" for c in letters),
            "n_letters": len(letters), "n_shouts": sum(c in q.SHOUTS for c in t), "n_digits": sum(c in q.DIGITS for c in t)}


def bits(m):
    return sum(q.BIT[name] for name, fails in q.RULES.items() if eval(fails, {}, m))


ODD = [None, "", " \t\r\x0b\f\n", "a a a", "a a a a", "a b a b a b", "one two\none two\n\n \none two", "x" * 5000, "É" * 40 + " é!", "wörd " * 30000,
       "a b c " + " ".join(f"w{i}" for i in range(500)) + " a b c", "!! ?? ## 12 34", "    nbsp", "\U0001F600 é", "A\nB\rC"]


def test_measurements_and_bits_match_the_plain_way(spark, odd, corpus):
    texts = ODD + [r.text for r in odd.select("text").collect()] + [t for _, t in corpus]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("m", F.lit("clash"))
    rows = {r.doc_id: r for r in q.ledger(df).collect()}
    assert len(rows) == len(texts) and rows[0].words == "clash"
    for i, t in enumerate(texts):
        m = plain(t)
        assert {k: rows[i][k] for k in m} == m, (i, (t or "")[:60])
        assert rows[i].fail_bits == bits(m)


def test_rows_stay_one_by_one(spark, odd, none):
    assert q.ledger(odd).count() == odd.count()
    assert q.ledger(none).count() == 0 and q.ablations(q.ledger(none)).count() == 0
    replaced = q.ledger(odd.withColumn("fail_bits", F.lit("clash")).withColumn("n_words", F.lit("clash")))
    assert dict(replaced.dtypes)["fail_bits"] == dict(replaced.dtypes)["n_words"] == "bigint" and replaced.columns.count("n_words") == 1


def test_policies_and_ablations_match_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in corpus] + [(-1, t, "odd") for t in ODD], "doc_id long, text string, source string")
    policies = [*q.POLICIES, q.Policy("lenient", tuple(q.RULES), tolerated=1)]
    book = q.ledger(df)
    all_bits = [(r.source, r.fail_bits) for r in book.collect()]
    keep = lambda p, b, without=0: (b & p.mask & ~without).bit_count() <= p.tolerated
    got = {(r.version, r.rule): tuple(r)[2:] for r in q.ablations(book, policies).collect()}
    assert len(got) == sum(len(p.rules) for p in policies)
    for p in policies:
        for rule in p.rules:
            assert got[p.version, rule] == (len(all_bits), sum(b & q.BIT[rule] != 0 for _, b in all_bits), sum(keep(p, b) for _, b in all_bits),
                                            sum(keep(p, b, q.BIT[rule]) for _, b in all_bits))
    for r in q.apply_policies(book, policies).withColumn("sole", q.sole_rule(q.CURRENT, F.col("fail_bits"))).withColumn("names", q.rule_names(F.col("fail_bits"))).collect():
        assert r.verdicts == {p.version: keep(p, r.fail_bits) for p in policies}
        alone = [x for x in q.CURRENT.rules if not keep(q.CURRENT, r.fail_bits) and keep(q.CURRENT, r.fail_bits, q.BIT[x])]
        assert r.sole == (alone[0] if len(alone) == 1 else None)
        assert r.names == [x for x in q.RULES if r.fail_bits & q.BIT[x]]
    for r in q.rule_profile(book, "source").collect():
        own = [b for s, b in all_bits if s == r.source]
        some, every = 0, -1
        for b in own:
            some, every = some | b, every & b
        assert (r.n_docs, r.some_bits, r.all_bits) == (len(own), some, every)


def test_junk_goes_and_clean_texts_stay(spark):
    from ledgerlens.llm.queries import QUERIES

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op13_quality_rules"](spark, "/root/testdata/sf0.01")
    kept = {r.quality: r.share for r in out.where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.4
    assert out.where("base_failed and kept").count() == 0


def test_plan_runs_no_python(spark):
    from ledgerlens.llm.queries import QUERIES

    plan = QUERIES["op13_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
