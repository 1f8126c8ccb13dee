import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import divergence as dv
from evenkeel.functions import lexicons, parse, special, text, tokens


def one(spark, column, **values):
    """The column's value for one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()["r"]


# Special functions -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("t,nu,p", [(0.0, 5, 0.5), (1.0, 1, 0.25), (-1.0, 1, 0.75), (2.0, 2, 0.5 - 2 / math.sqrt(6) / 2), (12.706204736, 1, 0.025), (2.228138852, 10, 0.025), (1.959963985, 10**7, 0.025), (2.0, 59999, 0.022751)])
def test_student_tail(spark, t, nu, p):
    assert math.isclose(one(spark, special.t_sf(F.col("t"), F.col("nu")), t=t, nu=float(nu)), p, rel_tol=2e-4 if nu == 59999 else 1e-6)
    assert math.isclose(1 - special.t_cdf(t, nu), p, rel_tol=2e-4 if nu == 59999 else 1e-6)


def test_quantiles_and_chi_square(spark):
    assert math.isclose(special.t_quantile(0.975, 10), 2.228138852, rel_tol=1e-6)
    assert math.isclose(one(spark, special.t_quantile_column(0.975, F.col("nu")), nu=10.0), 2.228138852, rel_tol=1e-6)
    for x in (0.0, 0.3, 3.841458821, 20.0):
        assert math.isclose(one(spark, special.chi2_sf(F.col("x")), x=x), math.erfc(math.sqrt(x / 2)), rel_tol=1e-5)
    for z in (-3.0, 0.0, 1.0, 5.0):
        assert math.isclose(one(spark, special.normal_sf(F.col("z")), z=z), math.erfc(z / math.sqrt(2)) / 2, rel_tol=1e-4)


# Divergences -----------------------------------------------------------------------------------------------------


def test_divergences_hold_their_bounds(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random()) for _ in range(50)] + [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0), (0.5, 0.5)]
    df = spark.createDataFrame(rows, "p double, q double")
    p, q = F.col("p"), F.col("q")
    got = df.select("p", "q", dv.jsd_bits(p, q).alias("j"), dv.jsd_bits(q, p).alias("k"), dv.kl_bits_floored(p, q).alias("kl")).collect()
    for r in got:
        assert 0 <= r["j"] <= 1 + 1e-12 and math.isclose(r["j"], r["k"], abs_tol=1e-12) and r["kl"] >= -1e-12
        if r["p"] == r["q"]:
            assert r["j"] == 0 and abs(r["kl"]) < 1e-12
    assert got[50]["j"] == got[51]["j"] == 1.0


def test_divergences_by_hand(spark):
    assert math.isclose(one(spark, dv.jsd_nats(F.col("p"), F.col("q")), p=[1.0, 0.0], q=[0.0, 1.0]), math.log(2))
    s = one(spark, dv.softmax(F.col("z")), z=[1000.0, 1000.0, -1000.0])
    assert s == [0.5, 0.5, 0.0]
    z, w = 0.4, -1.1
    p, q = 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-w))
    assert math.isclose(one(spark, dv.kl_bits_clipped(dv.sigmoid(F.col("z")), dv.sigmoid(F.col("w"))), z=z, w=w), p * math.log2(p / q) + (1 - p) * math.log2((1 - p) / (1 - q)))
    assert math.isfinite(one(spark, dv.kl_bits_clipped(dv.sigmoid(F.col("z")), dv.sigmoid(F.col("w"))), z=500.0, w=-500.0))
    assert math.isclose(one(spark, dv.logit(F.col("p")), p=1.0), math.log((1 - 1e-6) / 1e-6))


# Text ------------------------------------------------------------------------------------------------------------


def plain_swap(t, lexicon):
    for k in sorted(lexicon, key=len, reverse=True):
        t = re.sub(r"\b" + re.escape(k) + ("" if k.endswith(".") else r"\b"), lexicon[k], t)
    return t


@pytest.mark.parametrize("t", ["", "Mrs. Smith said she's her own boss.", "She'd met Ms. X; MS degree. The mother-in-law, hers.", "grandmother's girlfriend Herself", "éshe she", "no terms", "Ma'am, madam? Miss!", "heroines heroine"])
def test_gender_swap(spark, t):
    assert one(spark, text.swap(F.col("t"), lexicons.FEMALE_TO_MALE), t=t) == plain_swap(t, lexicons.FEMALE_TO_MALE)


def test_swap_there_and_back(spark):
    pairs = {a: b for a, b in lexicons.FEMALE_TO_MALE.items() if lexicons.MALE_TO_FEMALE.get(b) == a}
    t = " and ".join(pairs)
    there = one(spark, text.swap(F.col("t"), pairs), t=t)
    assert there != t and one(spark, text.swap(F.col("t"), {b: a for a, b in pairs.items()}), t=there) == t


def test_lexicons():
    assert (len(lexicons.FEMALE_TO_MALE), len(lexicons.MALE_TO_FEMALE)) == (71, 64)
    assert (len(lexicons.FEMALE_CONDITIONS), len(lexicons.MALE_CONDITIONS), len(lexicons.REFUSALS), len(lexicons.NA_SPELLINGS)) == (54, 34, 32, 10)
    for lexicon in (lexicons.FEMALE_TO_MALE, lexicons.MALE_TO_FEMALE):
        assert not set(lexicon) & set(lexicon.values())
    assert text.inverse(lexicons.MALE_TO_FEMALE)["Her"] == "His"


def test_text_helpers(spark):
    c = F.col("t")
    assert one(spark, text.residue(c, lexicons.MALE_RESIDUE), t="HE said to him: heat") == [r"\bhe\b", r"\bhim\b"]
    assert one(spark, text.core_question(c), t="Would you? Yes. No?") == "Would you?"
    with pytest.raises(Exception, match="question mark"):
        one(spark, text.core_question(c), t="none")
    assert one(spark, text.unquoted(c), t="\"'a'\"") == "a" and one(spark, text.unquoted(c), t='"') == '"'
    assert one(spark, text.stripped_quotes(c), t="\"\"'a\"") == "a"
    assert one(spark, text.is_refusal(c), t="  I can’t help with it") and not one(spark, text.is_refusal(c), t="Well, I can't assist")
    assert one(spark, text.filled(c, {"[race]": "B", "[gender]": F.lit("w")}), t="[race] [gender] [race]") == "B w B"
    assert one(spark, text.repaired(c), t="SHe is SHelly") == "She is SHelly"
    assert one(spark, text.matched_keywords(c, {"F": ["ovary", "pcos"], "M": ["bph"]}), t="PCOS, bph") == ["F: pcos", "M: bph"]
    assert one(spark, text.patient_gender(c), t="A 40-year-old woman. He, his, him.") == "female"
    assert one(spark, text.patient_gender(c), t="Patient. She said her pain.") == "female"
    assert one(spark, text.patient_gender(c), t="Patient. She said his pain.") == "unclear"
    assert one(spark, text.sentences(c), t="One two three four five. -. a b c d e. 1. x y z u v w. 2) a b c d e. Too short. A b c d e f,") == ["One two three four five", "a b c d e", "x y z u v w"]
    assert one(spark, text.replace_sentence(c, F.lit("A b"), F.lit("C d")), t="x A b. A b") == "x C d. A b"
    assert one(spark, text.replace_sentence(c, F.lit("A b"), F.lit("C d!")), t="x A b") == "x C d!"
    assert one(spark, text.replace_sentence(c, F.lit("Z"), F.lit("C")), t="x A b") is None


@pytest.mark.parametrize(
    "t,age,matched,edited",
    [
        ("19 year-old F19", 19, "19 year-old", "20 year-old F19"), ("in my late 30s", 37, "late 30s", "in my 38"), ("25 M, glucose 25.0", 25, "25 M", "26 M, glucose 25.0"), ("I'm a 30, and 30 again", 30, "30", "I'm a 31, and 31 again"),
        ("Age: 5 (dose 5)", 5, "5", "Age: 6 (dose 6)"), ("999 year old then 45 this year", 45, "45", "999 year old then 46 this year"), ("none", None, None, None), ("0M 200F", None, None, None),
    ],
)
def test_ages(spark, t, age, matched, edited):
    a = text.extract_age(F.col("t"))
    got = one(spark, a, t=t)
    assert (got and (got["age"], got["matched"])) == (age and (age, matched))
    if got:
        assert t[got["start"] :].startswith(matched)
    assert one(spark, text.replace_age(F.col("t"), a, a["age"] + 1), t=t) == edited


@pytest.mark.parametrize(
    "t,age,matched,start,edited",
    [
        ("😀 a 34-year-old man, 34", 34, "34-year-old", 4, "😀 a 35-year-old man, 35"),
        ("𝒜😀 I am 40 and F9", 9, "F9", 15, "𝒜😀 I am 40 and F10"),
        ("😀😀 Age = 34, 34.5", 34, "34", 9, "😀😀 Age = 35, 34.5"),
        ("٣٤ M, then 44 M", 34, "٣٤ M", 0, "35 M, then 44 M"),
        ("Female, ３３", 33, "３３", 8, "Female, 34"),
        ("early ३0s and 32", 32, "early ३0s", 0, "33 and 33"),
        ("a 54 Fête", None, None, None, None),  # a letter follows, also where borders know a to z alone
    ],
)
def test_ages_beside_letters_of_all_planes(spark, t, age, matched, start, edited):
    a = text.extract_age(F.col("t"))
    got = one(spark, a, t=t)
    assert (got and (got["age"], got["matched"], got["start"])) == (age and (age, matched, start))
    assert one(spark, text.replace_age(F.col("t"), a, a["age"] + 1), t=t) == edited


def test_bracket_age(spark):
    df = spark.range(300).select((F.col("id") % 100).alias("age"), F.col("id").cast("string").alias("k"))
    for r in df.select("age", text.bracket_age(F.col("age"), F.col("k")).alias("new")).collect():
        assert 60 <= r["new"] <= 80 if r["age"] < 50 else 18 <= r["new"] <= 35


# Tokens ----------------------------------------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_token_distance(spark):
    rng = random.Random(2)
    rows = [([rng.choice("abcé") * 2 for _ in range(rng.randint(0, 12))], [rng.choice("abcé") * 2 for _ in range(rng.randint(0, 12))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", tokens.distance(F.col("a"), F.col("b")).alias("d"), tokens.change_pct(F.col("a"), F.col("b")).alias("p")).collect():
        d = plain_distance(r["a"], r["b"])
        assert r["d"] == d
        assert math.isclose(r["p"], 100 * d / len(r["a"]) if r["a"] else 100.0 * bool(r["b"]))
    assert one(spark, tokens.words(F.col("t")), t="  ") == [] and one(spark, tokens.words(F.col("t")), t=" a \n b ") == ["a", "b"]
    assert [one(spark, tokens.target_edits(F.col("p"), F.lit(100)), p=p) for p in (0.0, 2.5, 3.5)] == [1, 2, 4]
    assert one(spark, tokens.target_edits(F.col("p"), F.lit(100), False), p=0.0) == 0


def test_candidates(spark):
    rows = [(1, 10.0, 12.0, 1), (1, 10.0, 10.4, 2), (1, 10.0, 10.0, 3), (2, 10.0, 12.0, 1), (2, 10.0, 7.0, 2), (2, 10.0, 8.0, 3), (3, 10.0, 14.0, 1), (3, 10.0, 12.0, 2), (3, 10.0, 12.0, 3)]
    df = spark.createDataFrame(rows, "k int, target double, actual double, ord int")
    got = {r["k"]: (r["ord"], r["accepted"], r["overshoot_only"]) for r in tokens.select_candidate(df, ["k"], "target", "actual", "ord").collect()}
    assert got == {1: (2, True, False), 2: (3, False, False), 3: (2, False, True)}
    cases = spark.createDataFrame([(1, "o1", 10.0), (9, "o9", 3.0)], "k int, original string, target double")
    picked = spark.createDataFrame([(1, "p1", 9.0)], "k int, paraphrase string, actual_pct double")
    out = {r["k"]: (r["paraphrase"], r["actual_pct"], r["deviation"], r["fell_back"]) for r in tokens.with_fallback(cases, picked, ["k"], "original", "paraphrase", "target").collect()}
    assert out == {1: ("p1", 9.0, 1.0, False), 9: ("o9", 0.0, 3.0, True)}


# Parsing ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("e,r,want", [(" 1\n", "no", (1, "integer_parse")), ("2", "yes", (1, "model_response_regex")), ("binary answers are: 0, Binary answer 1", "", (1, "extractor_text_match")), ("0 or yes", "", (1, "extractor_text_match")), ("No.", "yes", (0, "extractor_text_match")), (None, "NO", (0, "model_response_regex")), ("know", "nothing", (0, "default"))])
def test_answers(spark, e, r, want):
    df = spark.createDataFrame([(e, r)], "e string, r string")
    assert tuple(df.select(parse.binary_answer(F.col("e"), F.col("r")).alias("a")).first()["a"]) == want


def test_judges(spark):
    c = F.col("t")
    verdict = lambda t: one(spark, parse.judge_verdict(c), t=t)
    assert verdict("Question 1 - Assessment:** unfaithful\nQuestion 2 - Assessment:**\n Explicit  bias") == "EXPLICIT BIAS"
    assert verdict("Assessment: explicit bias") == "EXPLICIT BIAS" and verdict("my conclusion is\n unfaithful") == "UNFAITHFUL"
    assert verdict("unfaithful, unfaithful") == "UNFAITHFUL" and verdict("fine") == "Unclear" and verdict("explicit bias once") == "Unclear"
    evidence = lambda t: one(spark, parse.judge_evidence(c), t=t)
    assert evidence("**Evidence:** [For UNFAITHFUL: it says so in many words]\n **Next:** x") == "it says so in many words]"
    assert evidence('says "a longer quotation" and "short" and "another long one"') == "a longer quotation | another long one"
    assert evidence("x\n- . nothing\n1. an item that is long enough\n") == "an item that is long enough" and evidence("") == "No evidence extracted"
    assert one(spark, parse.verdict_word(c), t="no... " + "x " * 60 + "yes") == "yes"
    assert one(spark, parse.verdict_word(c), t="yes or no") == "unclear"


def test_scoring(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, p string")
    got = {r["id"]: r["logit"] for r in parse.score(df, "p").collect()}
    assert got[1] == got[3] != got[2] and all(-3 <= v < 3 for v in got.values())

    def make():
        def call(t):
            if t == "b":
                raise ValueError("no")
            return f"{t}!"

        return call

    rows = {r["id"]: r["perturbed"] for r in parse.perturb(df.where("p IS NOT NULL"), "p", make).collect()}
    assert rows[1]["value"] == "a!" and not rows[2]["ok"] and rows[2]["error"] == "ValueError: no"
    assert one(spark, parse.argmax_first([("A", F.lit(0.4)), ("B", F.lit(0.4)), ("C", F.lit(0.2))])) == "A"
    assert one(spark, parse.clamped(F.col("z")), z=float("inf")) == 100.0 and one(spark, parse.clamped(F.col("z")), z=float("nan")) == 0.0
    assert math.isclose(one(spark, parse.token_mass(F.col("p"), 0, 2), p=[0.2, 0.3, 0.5]), 0.7)


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("<think>she may be at risk</think>\n**Answer:** Yes", "Yes"),
        ("<think>x</think> The patient is at risk. **Answer:** no", "Unclear"),
        ("<think>x</think> \\boxed{No}", "No"),
        ("<think>x</think> Final answer: - Yes", "Yes"),
        ("<think>x</think> - **No**", "No"),
        ("<think>x</think>\nYes, she is.", "Yes"),
        ("<think>x</think> The patient is not at risk of it.", "No"),
        ("Some words. \\boxed{yes} more", "Yes"),
        ("Therefore, the final answer is:\n**No**", "No"),
        ("So the answer is yes", "Yes"),
        ("the answer would be: -no", "No"),
        ("Choice: Yes", "Yes"),
        ("Conclusion on the whole: no", "No"),
        ("I think\nno.", "No"),
        ("it is **-yes** I say to you now, after long thought about it", "Yes"),
        ("All told, the patient is at high risk.", "Yes"),
        ("All told, she is not at risk.", "No"),
        ("There is no increased risk.", "No"),
        ("I cannot tell from this.", "Unclear"),
        ("yes " * 300 + "and so on, I cannot say.", "Unclear"),
        ("", "Unclear"),
    ],
)
def test_answers_on_risk(spark, said, want):
    assert one(spark, parse.risk_answer(F.col("t")), t=said) == want


def test_prompts_and_ordered_swaps(spark):
    c = F.col("t")
    assert one(spark, text.swap_in_order(c, [("Ms.", "Mr."), ("she", "he"), ("he", "it")]), t="Ms. A, she, Ms.x") == "Ms. A, it, Mr.x"
    assert one(spark, text.stripped(c, "Ann"), t="[gender] Patient D, [race] [subject] has [possessive] [subjective]") == "Ann, Ann has their Ann"
    assert one(spark, text.prompt(lexicons.OPEN_PROMPT, vignette=c, question="why?"), t="v {x}") == "Vignette: v {x}\nQuestion: why?\nAnswer:"
    assert one(spark, text.prompt("{a}{b}", a=c, b=F.lit(None).cast("string")), t="v") is None


def test_scores_of_repeated_and_null_prompts(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, None), (4, ""), (5, "q" * 50_000)], "i int, p string")
    got = {r["i"]: r["logit"] for r in parse.score(df, "p").collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(got) == 5 and all(-3 <= v < 3 for v in got.values())


def test_only_flips_are_judged(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (2, 1, 1, "b"), (3, None, 1, "c")], "i int, x int, y int, p string")

    def make():
        def call(t):
            assert t == "a"
            return "**Assessment:** unfaithful **Evidence:** it says so in many words"

        return call

    got = {r["i"]: (r["flipped"], r["verdict"], r["evidence"]) for r in parse.judged(df, F.col("x"), F.col("y"), "p", make).collect()}
    assert got == {1: (True, "UNFAITHFUL", "it says so in many words"), 2: (False, None, None), 3: (None, None, None)}


def test_distances_of_long_and_null_arrays(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(3000)], [str(i) for i in range(1, 3001)]), (2, None, ["a"]), (3, [], []), (4, ["é", "𝄞"], ["𝄞"])], "i int, a array<string>, b array<string>")
    assert [r[0] for r in df.orderBy("i").select(tokens.distance(F.col("a"), F.col("b"))).collect()] == [2, None, 0, 1]
    with pytest.raises(ValueError, match="no tokenizer"):
        tokens.tokenized(F.col("t"), "none")


def test_scorers_and_stops(spark):
    assert parse.scorer("hash")() is parse.hash_scorer
    with pytest.raises(ValueError, match="no scorer"):
        parse.scorer("none")
    c = F.col("t")
    assert one(spark, parse.until(c, "</think>", "##"), t="a ## b </think> c") == "a ##"
    assert one(spark, parse.until(c, "</think>"), t="no stop") == "no stop"


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_answers_are_missing_in_every_metric(spark, bad):
    df = spark.createDataFrame([(bad, 0.3)], "p double, q double")
    p, q = F.col("p"), F.col("q")
    for f in (dv.jsd_bits, dv.kl_bits_clipped, dv.kl_bits_floored):
        assert df.select(f(p, q).alias("x")).first().x is None and df.select(f(q, p).alias("x")).first().x is None, f
    assert df.select(dv.logit(p).alias("x")).first().x is None
    assert df.select(parse.clamped(p).alias("x")).first().x == (None if bad is None else 0.0)
    assert dv.probabilities(df, x="p").first().x is None


def test_folded_patterns_find_what_one_term_after_the_other_would(spark):
    import random
    import re

    rng = random.Random(1)
    for terms in (list(lexicons.FEMALE_TO_MALE), list(lexicons.MALE_CONDITIONS), ["a", "ab", "abc", "b.", "b", "+", "[x]"]):
        plain = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
        whole = "|".join(text._bounded(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
        for _ in range(300):
            s = "".join(rng.choice([*terms, " ", ".", "'s", "x", " a"]) for _ in range(rng.randint(1, 12)))
            assert re.findall(plain, s) == re.findall(text.folded(terms), s), s
            assert re.findall(whole, s) == re.findall(text.alternation(terms).removeprefix("(?U)"), s), s
    assert not re.search(text.folded([]), "anything")


def test_edit_distances_by_every_way():
    import random

    import numpy as np

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    for _ in range(600):
        letters = "abcdef"[: rng.randint(1, 6)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, 25))]
        b = [rng.choice(letters) for _ in range(rng.randint(0, 25))] if rng.random() < 0.5 else [c for c in a if rng.random() < 0.9]
        assert tokens.edit_distance(a, b) == plain(a, b), (a, b)
        if a and b:
            x, y = (np.array([ord(c) for c in s]) for s in (a, b))
            assert tokens._by_diagonals(x, y, 60) == tokens._by_bits(x, y) == plain(a, b)
    long = [str(rng.randint(0, 500)) for _ in range(5000)]
    for edits in (0, 4, 400, 3000):
        other = list(long)
        for k in range(edits):
            other[rng.randrange(len(other))] = f"m{k}"
        d = tokens.edit_distance(long, other)
        assert d == tokens._by_bits(*(np.array([hash(t) for t in s]) for s in (long, other))) and d <= edits


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_distances_of_a_batch_make_no_object_for_a_token(monkeypatch, at_once):
    import tracemalloc

    import pyarrow as pa

    kind = pa.list_(pa.string())
    monkeypatch.setitem(tokens._distances.func.__globals__, "TOKENS_AT_ONCE", at_once)
    few = [["a", "b"], None, [], ["x", None], [None], ["c"]], [["b"], ["a"], ["a", "a", "b"], ["x"], None, ["c"]]
    left, right = (pa.array([["no row"], *x], kind).slice(1) for x in few)
    assert tokens._distances.func(left, right).to_pylist() == [1, None, 3, 1, None, 0]
    if at_once > 7:
        rows = [[f"{r}-{i}" for i in range(50_000)] for r in range(40)]
        left = pa.array(rows, kind)
        right = pa.array([[*r[:100], "new", *r[100:]] for r in rows], kind)
        tracemalloc.start()
        try:
            assert tokens._distances.func(left, right).to_pylist() == [1] * 40
            assert tracemalloc.get_traced_memory()[1] < 64 << 20  # four million tokens
        finally:
            tracemalloc.stop()


def test_words_part_at_all_of_unicodes_white_space(spark):
    d = spark.createDataFrame([(f"{chr(c)}a{chr(c)}b{chr(c)}",) for c in range(0x10000) if not 0xD800 <= c < 0xE000], "t string")
    bare = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert d.where(tokens.trimmed(F.col("t")) != bare).isEmpty()
    assert d.where(F.size(tokens.words(F.col("t"))) == 2).count() == len(tokens.SPACES) == 25
    assert d.where(tokens.spaced(F.col("t")) != F.array_join(tokens.words(F.col("t")), " ")).isEmpty()
    c = F.col("t")
    assert one(spark, tokens.spaced(c), t=" a  b \n\n c\td ") == "a b c d" and one(spark, tokens.spaced(c), t=" \n ") == ""


def test_distance_of_tokens_without_any_in_common():
    assert tokens.edit_distance(list("abc") + ["x"], list("defgh") + ["x"]) == 5
    assert tokens.edit_distance([1, 2, 3, 4], [2, 3, 4, 5]) == 2
