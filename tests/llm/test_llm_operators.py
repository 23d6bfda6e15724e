import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutario.llm import answers, components, consensus, leakage, near_duplicates, overlap_join, packing, residue, splitter
from minutario.llm.buckets import bucket_candidates

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def rows(df):
    return {tuple(r) for r in df.collect()}


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return {(x, find(x)) for x in parent}


# Components


@pytest.mark.parametrize("limit", [3, 40, 1_000_000])
def test_components_equal_brute_force_within_any_bound(spark, limit):
    rng = random.Random(limit)
    pairs = [(f"d{rng.randrange(150):03d}", f"d{rng.randrange(150):03d}") for _ in range(110)]
    pairs += [(f"c{n:03d}", f"c{n + 1:03d}") for n in range(40)]  # a chain
    pairs += [("hub", f"h{n:03d}") for n in range(60)] + [(None, "d001"), ("d001", "d001"), ("d001", None)]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(5)
    assert rows(components.tied_groups(df, "a", "b", limit)) == brute_components(pairs)


def test_components_of_nothing(spark):
    assert components.tied_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


# Buckets


def test_small_buckets_give_all_pairs_and_large_ones_their_members(spark):
    data = [(k, i) for k, n in ((1, 1), (2, 5), (3, 40)) for i in range(k * 1000, k * 1000 + n)]
    df = spark.createDataFrame(data, "key long, id long")
    found = bucket_candidates(df, lambda r, i, j: np.ones(len(i), bool), block=8).collect()
    assert {(r.a, r.b) for r in found if r.b is not None} == {(2000 + i, 2000 + j) for i in range(5) for j in range(i + 1, 5)}
    assert sorted((r.a, r.block) for r in found if r.key is not None) == [(3000 + i, i // 8) for i in range(40)]


# Near duplicates


def jaccard_groups(sets, threshold):
    ids = [i for i, s in sets.items() if s is not None and len(s) >= 8]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    group = {i: i for i in ids}
    group.update(dict(brute_components(links)))
    return group


def same_partition(found, wanted):
    def blocks(group):
        out = {}
        for k, g in group.items():
            out.setdefault(g, set()).add(k)
        return {frozenset(b) for b in out.values()}

    assert blocks(found) == blocks(wanted)


def noisy_sets(n, hot, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = rng.sample(words, 30)
    sets = {}
    for i in range(n):
        own = list(base) if i < hot else rng.sample(words, 30)
        if i >= hot and i % 3 == 0 and i > hot + 3:
            own = list(sets[i - 1])
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = rng.choice(words)
        sets[i] = set(own)
    return sets


@pytest.mark.parametrize("hot", [0, 300])
def test_near_duplicates_equal_brute_force_with_a_hot_group(spark, hot):
    sets = noisy_sets(600, hot, 7) | {1000: {"a", "b"}, 1001: set()}
    data = [(i, sorted(s)) for i, s in sets.items()] + [(2000, None), (0, sorted(sets[0]))]
    df = spark.createDataFrame(data, "k long, w array<string>")
    found = near_duplicates.near_duplicate_groups(df, "k", "w").collect()
    assert len(found) == 600
    same_partition({r.k: r.group_id for r in found}, jaccard_groups(sets, 0.7))


def test_registers_agree_with_the_weighted_similarity():
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(0, 2**63, 90, dtype=np.uint64)
    common = np.zeros(90, bool)
    common[:30] = True
    a, b = np.r_[0:30, 30:60], np.r_[0:30, 45:75]
    regs = near_duplicates.sketch(np.r_[a, b], vocabulary, common, np.array([0, len(a)]), range(1500))
    weight = 30 * near_duplicates.COMMON_WEIGHT
    wanted = (weight + 15) / (weight + 45)
    assert abs((regs[:, 0] == regs[:, 1]).mean() - wanted) < 0.03


def test_decision_words_take_the_row_that_holds(spark):
    day = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("A", "Ångström ÑANDÚ", None, day), ("A", "old", "old", datetime(2023, 1, 1)), ("B", None, None, None)],
        "decision_id string, sentence_text string, decision_content string, ingested_at timestamp",
    )
    assert {(r.decision_id, tuple(r.words)) for r in near_duplicates.decision_word_sets(df).collect()} == {("A", ("angstrom", "nandu")), ("B", ())}


def test_pairs_in_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "k string, g int")
    assert rows(near_duplicates.pairs_in_groups(df, "k", "g")) == {("a", "b"), ("a", "c"), ("b", "c")}


# Overlap join


def test_boundary_of_small_sets_has_the_least_cost():
    assert overlap_join.small_size({}, 3) == 2
    assert overlap_join.small_size({3: (10, 40), 8: (5, 30), 20: (1, 900)}, 3) == 3  # 56 subsets of eight cost more than six entries each
    assert overlap_join.small_size({3: (10, 40), 8: (5, 3000), 20: (1, 9000)}, 3) == 20


@pytest.mark.parametrize("small", [2, 4, 6, 14, None])
def test_overlap_join_equals_brute_force(spark, small):
    rng = random.Random(small or 1)
    words = [f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    sets = {i: (f"p{i % 3}", sorted({rng.choice(words) for _ in range(rng.randrange(1, 12))})) for i in range(260)}
    sets |= {i: ("p9", ["x", "y", "z", f"q{i}"]) for i in range(300, 480)}  # one subset holds them all
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in sets.items()] + [(999, "p0", None)], "id long, part string, tokens array<string>")
    wanted = {
        (a, b) for a, (p, x) in sets.items() for b, (q, y) in sets.items()
        if a < b and p == q and len(set(x) & set(y)) >= 3 and len(set(x) & set(y)) / min(len(x), len(y)) >= 0.75
    }
    assert rows(overlap_join.overlap_pairs(df, small=small, list_block=7).select("a", "b")) == wanted


def test_candidate_decisions_normalise_ids_and_merge_texts(spark):
    day = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("p1", " is1009A.D05 ", "IS1009b.d01", "The blue motor", None, day), ("p2", "IS1009a.d05", "IS1009a.d05", "Motor casing", "", day)],
        "pair_id string, earlier_decision_id string, later_decision_id string, earlier_text string, later_text string, ingested_at timestamp",
    )
    got = {(r.decision_id, r.series_id, r.meeting_id, tuple(r.terms)) for r in overlap_join.candidate_decisions(df).collect()}
    assert got == {("IS1009a.d05", "IS1009", "IS1009a", ("blue", "casing", "motor")), ("IS1009b.d01", "IS1009", "IS1009b", ())}


# Splitter


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\t\r¿é", max_size=400), st.integers(5, 40))
def test_pieces_cover_the_text_within_the_limit(text, limit):
    pieces = splitter.split_text(text, limit, limit // 4)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in pieces)
    for (_, b, _), (a, _, _) in zip(pieces, pieces[1:]):
        assert a <= b and b - a <= limit // 4
    longest = max(map(len, __import__("re").findall(r"[^ \t\r\n]+", text)), default=0)
    if len(text) > limit:
        assert any(f for *_, f in pieces) == (longest > limit)


def test_pieces_of_null_empty_and_unknown_start(spark):
    df = spark.createDataFrame([("a", None, 5, 1), ("b", "", None, 2), ("c", "word " * 300, 100, 3)], "chunk_id string, text string, char_start int, piece int")
    got = splitter.split_pieces(df, "chunk_id").collect()
    assert {r.chunk_id for r in got} == {"b", "c"}
    assert [r.char_start for r in got if r.chunk_id == "b"] == [None]
    assert all(r.char_start == 100 + r.from_char and not r.forced for r in got if r.chunk_id == "c")
    assert splitter.split_pieces(df.where("false"), "chunk_id").count() == 0


# Answers


ANSWERS = [
    (None, "Who?", "E1", "empty"), (" … ", "Who?", "E1", "empty"), ("(none)", "Who?", "E4", "empty"), ("N/A", "Who?", "E1", "empty"),
    ("I don’t know", "Who has to review it?", "E1", "refusal"), ("I don't know", "Who has to review it?", "E4_unanswerable", None),
    ("No lo sé.", "¿Quién debe revisar el menú?", "E2", "refusal"),
    ("Answer: Who has to drop the dial", "Who has to drop the dial?", "E1", "copy"),
    ("WHO HAS TO DROP THE DIAL?", "Who has to drop the dial?", "E1", "copy"),
    ("Who has to drop the dial: The team.", "Who has to drop the dial?", "E1", None),
    ("The team", "Who has to drop the dial?", "E1", None), ("- dial\n- menu\n- felt", "Which?", "E1", None),
    ("It was dropped because the", "Why was the dial dropped?", "E1", "truncated"),
    ("It was dropped because of dust. [2]", "Why was the dial dropped?", "E1", None),
    ("It was dropped because of dust…", "Why was the dial dropped?", "E1", "truncated"),
    ("Se descartó porque el equipo decidió que faltaba tiempo.", "Why was the dial dropped by the team?", "E1", "language"),
    ("The team chose «el menú de la casa» for the wall.", "Which menu did the team choose?", "E1", None),
]
REVIEWS = "pregunta_id string, stratum string, pregunta string, respuesta_referencia string, respuesta_c2 string, ingested_at timestamp"


def reviews(spark, rows_):
    """Rows (id, stratum, prompt, reference, answer) beside sound ones in two languages to learn from."""
    sound = [(f"e{i}", "E1", "Who has to test the steel dial of the team?", "The team noted that steel beats cork, for heat was not on the list.", "That falls to the team.") for i in range(9)]
    sound += [(f"s{i}", "E1", "¿Quién debe probar el mando de la sala?", "El equipo dijo que la madera gana por el calor de la sala.", "Lo debe probar el equipo.") for i in range(9)]
    return spark.createDataFrame([(*r, datetime(2024, 1, 1)) for r in [*sound, *rows_]], REVIEWS)


def test_defects(spark):
    df = reviews(spark, [(f"q{n}", stratum, prompt, None, answer) for n, (answer, prompt, stratum, _) in enumerate(ANSWERS)])
    assert dict(rows(answers.defective_answers(df))) == {f"q{n}": wanted for n, (*_, wanted) in enumerate(ANSWERS) if wanted}


def test_copies_are_decided_by_compression():
    prompt = "Which material did the team choose for the dial by Cofagus?"
    assert answers.is_copy("Answer: " + prompt, prompt) and answers.is_copy(prompt + " " + prompt, prompt)
    assert not answers.is_copy(prompt + " Oak.", prompt)  # three bytes of its own
    assert not answers.is_copy("Cofagus", prompt) and not answers.is_copy("", prompt) and not answers.is_copy(prompt, "")


def test_terminal_contexts_tell_bare_answers_from_cut_ones(spark):
    """The model alone tells them: the same three words end no text where the references go on."""
    texts = [(f"r{i}", "E1", "What was set?", "A price of ten euros was set for it." if i else "Dust and noise", None) for i in range(30)]
    got = rows(answers.defective_answers(reviews(spark, [*texts, ("x", "E1", "What was set?", None, "A price of"), ("y", "E1", "Why?", None, "Dust and noise")])))
    assert {r for r in got if r[0] in "xy"} == {("x", "truncated")}
    assert answers.last_context("It was set (see the list).") == ("close", "list", 4)
    assert answers.last_context("It was set. The list") == ("word", "list", 6) and answers.last_context("Why was it? The list") == ("word", "list", 2)
    assert answers.last_context("It was set. [2, 3]")[0] == "close" and answers.last_context("") == ("mark", "", 0)


def test_shapes_given_where_declining_is_right_are_refusals(spark):
    """A made-up way to decline that no dictionary lists is learnt from the stratum where it is right."""
    made = [(f"r{i}", "E4_unanswerable" if i < 60 else "E1", "Who has to go?", None, f"Beyond my remit is Name{chr(97 + i % 26)}.") for i in range(90)]
    other = [(f"o{i}", "E4_unanswerable" if i < 9 else "E1", "Who has to go?", None, f"That would be Name{chr(97 + i % 26)}.") for i in range(300)]
    got = rows(answers.defective_answers(reviews(spark, made + other)))
    assert got == {(f"r{i}", "refusal") for i in range(60, 90)}


def test_defective_answers_table(spark):
    day = datetime(2024, 1, 1)
    schema = "pregunta_id string, stratum string, pregunta string, respuesta_referencia string, respuesta_c2 string, abstained boolean, word string, terminal double, ingested_at timestamp"
    df = spark.createDataFrame([("q1", "E1", "Who has to go?", None, None, None, "x", 1.0, day), ("q1", "E1", "Who has to go?", None, "The team.", None, "x", 1.0, datetime(2023, 1, 1)), ("q2", None, None, None, "The team.", None, "", None, None)], schema)
    assert rows(answers.defective_answers(df)) == {("q1", "empty")}
    assert answers.defective_answers(df.where("false")).count() == 0


def test_language_without_function_words_is_told_by_the_learnt_dictionary(spark):
    schema = "pregunta_id string, stratum string, pregunta string, respuesta_referencia string, respuesta_c2 string, ingested_at timestamp"
    day = datetime(2024, 1, 1)
    rows_ = [(f"e{i}", "E1", "Who has to test the steel dial?", "The team noted that steel beats cork, for heat.", "The steel dial.", day) for i in range(9)]
    rows_ += [(f"s{i}", "E1", "¿Quién debe probar el mando?", "El equipo dijo que la madera gana por el calor.", "El mando.", day) for i in range(9)]
    rows_ += [("x", "E1", "¿Quién debe probar el mando?", None, "Noted: steel beats cork, heat.", day), ("y", "E1", "Who has to test the dial?", None, "Noted: steel beats cork, heat.", day)]
    found = rows(answers.defective_answers(spark.createDataFrame(rows_, schema)))
    assert found == {("x", "language")}


# Consensus


def simulated(n, seed):
    rng = np.random.default_rng(seed)
    labels, skill = ["x", "y", "z"], [0.95, 0.9, 0.85, 0.4]
    real = rng.integers(0, 3, n)
    votes = np.full((n, 4), -1)
    for a, p in enumerate(skill):
        right = rng.random(n) < p
        votes[:, a] = np.where(right, real, rng.integers(0, 3, n))
        votes[rng.random(n) < 0.15, a] = -1
    frame = pd.DataFrame(votes, columns=[f"v{a}" for a in range(4)])
    frame.insert(0, "item_id", [f"i{k}" for k in range(n)])
    frame["known"] = np.where(rng.random(n) < 0.2, real, -1)
    return labels, real, frame


def test_consensus_finds_labels_and_poor_annotators_either_way(spark):
    labels, real, frame = simulated(3000, 3)
    items = spark.createDataFrame(frame).select("item_id", *[F.col(f"v{a}").cast("int") for a in range(4)], F.col("known").cast("int")).repartition(3)
    near, far = consensus.fit(items, labels, list("abcd"), iterations=8), consensus.fit(items, labels, list("abcd"), in_driver=0, iterations=8)
    assert np.allclose(near.confusion, far.confusion, atol=1e-6)
    assert near.confusion[0].diagonal().min() > 0.9 > 0.7 > near.confusion[3].diagonal().max()
    sure = [r for r in consensus.consensus(items, near).collect() if r.probability > 0.95]
    assert np.mean([labels[real[int(r.item_id[1:])]] == r.consensus_label for r in sure]) > 0.97


def test_consensus_of_spelling_variants_and_no_labels(spark):
    df = spark.createDataFrame(
        [("a", " No-Decisión. ", "no decision", "?", None, datetime(2024, 1, 1)), ("b", None, "", "x", None, None)],
        "k string, gm_status string, gv_status string, ka_status string, final_status string, ingested_at timestamp",
    )
    items, people = consensus.held_items(df, "k", "_status", ["decision", "no_decision"])
    assert people == ["gm", "gv", "ka"]
    assert rows(items) == {("a", 1, 1, -1, -1), ("b", -1, -1, -1, -1)}
    judged = consensus.consensus(items, consensus.fit(items, ["decision", "no_decision"], people)).collect()
    assert [(r.item_id, r.consensus_label, r.agreement) for r in judged] == [("a", "no_decision", 1.0)]
    consensus.fit(items.where("false"), ["decision", "no_decision"], people)


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_no_container_overflows(lengths):
    sizes = np.array(lengths, np.int64)
    number = packing.pack(sizes, 100)
    assert len(number) == len(sizes) and (number >= 0).all()
    used = np.bincount(number, weights=sizes) if len(sizes) else np.zeros(0)
    assert (used <= 100).all() and (used > 0).all()
    if len(sizes):
        assert len(used) <= 2 * sizes.sum() / 100 + 1


def test_packing_is_close_to_the_bound():
    sizes = np.random.default_rng(0).integers(30, 1500, 4000)
    containers = packing.pack(sizes).max() + 1
    assert containers <= 1.05 * np.ceil(sizes.sum() / packing.CAPACITY)


def test_packed_texts_come_back_whole(spark):
    texts = [(1, "short text", 0), (2, "palabra larga é " * 1500, 1), (3, None, 2), (4, "", 3), (5, "short text", 4), (6, "漢字" * 3000, 5)]
    df = spark.createDataFrame(texts, "doc_id long, text string, shard int")
    got = packing.packed_containers(df, VOCABULARY).toPandas()
    assert set(got.doc_id) == {1, 2, 5, 6}
    assert got.groupby("container_id").n_tokens.sum().max() <= packing.CAPACITY
    for doc, text, _ in texts:
        own = got[got.doc_id == doc].sort_values("piece")
        assert "".join(text[a:b] for a, b in zip(own.from_char, own.to_char)) == (text or "")


# Leakage


def brute_leaks(docs, items):
    def seqs(t):
        w = leakage._WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    return {(d, i) for d, t in docs for i, p in items if seqs(p) and len(seqs(p) & seqs(t)) / len(seqs(p)) >= 0.3}


@pytest.mark.parametrize("bits", [1 << 10, 1 << 26])
def test_leaks_equal_brute_force(spark, monkeypatch, bits):
    """Whatever passes the filter: with 1,024 bits nearly everything does."""
    monkeypatch.setattr(leakage, "FILTER_BITS", bits)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeñé") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 110)))) for i in range(25)] + [(90, None), (91, "too short"), (92, "just one two three four")]
    docs = [(100, None), (101, ""), (102, "one two"), (103, " ".join(word() for _ in range(900)) + " just one, two THREE four. " + " ".join(word() for _ in range(900)))]
    for d in range(60):
        body = [word() for _ in range(rng.randrange(30, 3000))]
        for i, p in rng.sample(items[:25], 2):
            w = p.split()
            a = rng.randrange(len(w))
            body[rng.randrange(len(body)) : 0] = w[a : a + rng.randrange(5, len(w) + 5)]
        docs.append((d, "; ".join(body).upper()))
    x, y = spark.createDataFrame([*docs, docs[5]], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    found = rows(leakage.leaked_items(x, y).select("doc_id", "item_id"))
    assert found == brute_leaks(docs, items) and found
    assert leakage.leaked_items(x, y.where("false")).count() == 0


# Residue


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("The board [owner] agreed.", "placeholder"), ("Dear {{ name }}, welcome.", "placeholder"), ("«SERIES» was kept", "placeholder"),
        ("costs %price% euros", "placeholder"), ("We write `{series_id}` as its field.", None), ('such as {"noun": "wheel", "cost": 63} here', None),
        ("price[7] < cost * 54.45 and <novelty> is only a heading", None), ("It is settled [4] and done.", None), ("Up 20% and 30% again", None),
        ("Series: undefined\nOwner: null", "unset"), ("The null hypothesis holds", None),
        ("Lorem ipsum dolor sit amet magna aliqua velit", "filler"), ("The manual printed lorem ipsum on page 3 by mistake", None),
        ("404 Not Found\nnginx", "message"), ("Error 410: Gone", "message"), ("Error 404 is what testers in kitchens saw; it was fixed.", None),
        ("Please enable JavaScript to view this transcript.", "message"), ("Whether visitors must enable JavaScript was debated.", None),
        ("El aviso «acceso denegado» del mando asustó al grupo.", None), ("TBD.", "message"), ("Ok.", None), ("", None), (None, None),
        ("test test test 9", "message"), ("Testing went well in the test.", None),
    ],
)
def test_residue_rules(spark, text, wanted):
    df = spark.createDataFrame([(1, text, "s", "clash")], "doc_id long, text string, source string, reason string")
    got = [r.reason for r in residue.residue_documents(df).collect()]
    assert got == ([wanted] if wanted else [])


def test_recurring_texts_are_messages_but_copies_are_not(spark):
    data = [(i, f"Retry, the archive session {i} on this server was lost.", f"s{i % 3}") for i in range(9)]
    data += [(50 + i, "They moved the server room after the session of May.", f"s{i % 3}") for i in range(9)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(df).collect()} == set(range(9))


def residue_keys(spark, texts):
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    return {r.doc_id for r in residue.residue_documents(df).collect()}


def test_residue_finds_unlisted_pages_copied_or_reworded_over_many_sources(spark):
    content = [(f"The team of {a}{b} chose a red case for the {b}{a} remote.", f"s{i % 12}") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "klmnopqr")]
    copied = [("Whoops, the hamsters are asleep.", f"s{i % 12}") for i in range(30)]
    numbered = [(f"We hit a snag, come back later ({i}).", f"s{i % 12}") for i in range(24)]
    yes = [("Yes.", f"s{i % 12}") for i in range(40)]
    few = [("Nobody objected to the second prototype.", f"s{i % 12}") for i in range(4)]
    found = residue_keys(spark, copied + numbered + content + yes + few)
    assert found == set(range(54))


def test_residue_messages_have_no_length_limit_and_counts_are_exact(spark):
    tail = " The archive keeps minutes of many groups." * 20
    assert residue_keys(spark, [("403 Forbidden\nnginx" + tail, "a")]) == {0}
    assert residue_keys(spark, [(f"Retry {i}, this server lost the archive.{tail}", f"s{i % 2}") for i in range(3)]) == {0, 1, 2}


def test_residue_groups_decide_for_messages_and_fields_that_no_rule_lists(spark):
    """Made-up messages of no listed wording: reworded by a name, over sources; content that begins alike is longer."""
    made = [(f"We hit a snag while opening the folder. Mail {w} for help.", f"s{k % 12}") for k, w in enumerate(f"Name{chr(97 + n)}" for n in range(24))]
    long = [("We met again on Monday. " + f"Item {chr(97 + k)} was read and discussed at length by everyone " * 6, f"s{k % 12}") for k in range(24)]
    fields = [(f"The {a}venue{b} for week {k} is fixed.", f"s{k // 3}") for k, (a, b) in enumerate([("<", ">"), ("[", "]"), ("{", "}")] * 4)]
    single = [(f"The <comfort> of week {k} is fixed.", f"s{k % 3}") for k in range(6)]
    rows = [(n, t, s) for n, (t, s) in enumerate(made + long + fields + single)]
    got = {r.doc_id: r.reason for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {n: "recurring" for n in range(24)} | {n: "placeholder" for n in range(48, 60)}


def test_residue_filler_needs_the_passage_close_together(spark):
    rows = [(0, "Lorem fooble ipsum barble dolor quux amet done.", "a"), (1, "El dolor que sintió fue enorme y la culpa no era de nadie.", "a"), (2, "lorem ipsum", "a")]
    assert {r.doc_id for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {0}


def test_near_duplicates_in_passes_keep_no_shuffle_files_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL_ROWS", 0)
    base = [f"w{i}" for i in range(20)]
    data = [("a", base), ("b", base[:19] + ["x"]), ("c", base[:16]), ("d", [f"v{i}" for i in range(20)]), ("e", base[::-1])]
    found = {tuple(r) for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(data, "k string, w array<string>"), "k", "w").collect()}
    assert found == {("a", "a", "a"), ("b", "b", "a"), ("c", "c", "a"), ("d", "d", "d"), ("e", "a", "a")}


def test_bitmaps_pass_every_pair_that_reaches_the_threshold():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(400):
        words = rng.integers(-2**62, 2**62, 400)
        n = int(rng.integers(8, 300))
        sets += [words[:n], words[int(0.3 * n) : n]]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), pa.array(sets, pa.list_(pa.int64()))], names=["id", "words"])
    out = next(near_duplicates._band_rows(iter([batch]), np.array([], np.uint64), range(1)))
    rows = {c: out.column(c).to_numpy() for c in out.schema.names}
    assert near_duplicates._close(rows, np.arange(0, 800, 2), np.arange(1, 800, 2), 0.7).all()
    assert not near_duplicates._close(rows, np.arange(0, 798, 2), np.arange(2, 800, 2), 0.7)[[len(sets[i]) < 40 and len(sets[i + 2]) < 40 for i in range(0, 798, 2)]].any()
