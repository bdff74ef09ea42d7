"""Properties of the methods themselves."""

import numpy as np
from hypothesis import given, settings, strategies as st

from groundwire.llm import byte_bpe, chat, language, minhash_links, vector_links
from groundwire.llm.queries import bpe_files


def rows_of(spark, turns):
    return spark.createDataFrame([(1, n, r, t) for n, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")


TURNS = [("user", "a"), ("assistant", "<think>x</think>b"), ("user", "c"), ("assistant", "<think>y</think>d")]


def test_templates_that_rewrite_history_are_found(spark):
    def forgetful(turns):
        last = len(turns) - 1
        return "".join(f"[{r}]{t if n == last else t.split('</think>')[-1]}\n" for n, (r, t) in enumerate(turns))

    template = chat.Template(forgetful)
    segments = chat.format_turns(rows_of(spark, TURNS), template).orderBy("position").collect()
    assert [s.rewritten for s in segments] == [False, False, True, False]
    (row,) = chat.digests(chat.format_turns(rows_of(spark, TURNS), template), template).collect()
    assert row.rewritten and row.loss_sha256 is None


def test_spans_of_an_unknown_template(spark):
    def spaced(turns):
        return "<s>" + "".join(f"<{r}> {t.strip()} </{r}>" for r, t in turns)

    for lookback in (None, 0, 2):
        template = chat.Template(spaced, lookback=lookback)
        parts = chat.format_turns(rows_of(spark, TURNS), template).orderBy("position").collect()
        assert [p.segment[p.text_start : p.text_end] for p in parts] == [t for _, t in TURNS]
        assert [p.segment[p.role_start : p.role_end] for p in parts] == [r for r, _ in TURNS]
        if lookback is None:
            assert "".join(p.segment for p in parts) == spaced(TURNS)
            assert [p.start for p in parts] == [len("".join(q.segment for q in parts[:n])) for n in range(4)]


def conversation(n):
    return [(("user", "assistant")[k % 2], f"text {k} <|im_end|> \\ <think>{k}</think>") for k in range(n)]


def test_the_query_path_finds_rewritten_history(spark):
    """With the declaration of the query's template, and in conversations long and short."""
    def forgetful(turns):
        last = len(turns) - 1
        return chat._marked([(r, t if n == last else t.split("<think>")[0]) for n, (r, t) in enumerate(turns)])

    honest = chat.digests(chat.format_turns(rows_of(spark, conversation(70)))).first()
    assert not honest.rewritten and honest.formatted_chars == len(chat._marked(conversation(70)))
    template = chat.Template(forgetful, chat.unescape, lookback=chat.CHATML.lookback)
    for n in (2, 70):
        segments = chat.format_turns(rows_of(spark, conversation(n)), template).orderBy("position").collect()
        assert all(s.rewritten for s in segments[1:]) and not segments[0].rewritten
        assert chat.digests(chat.format_turns(rows_of(spark, conversation(n)), template), template).first().rewritten


def test_a_declared_lookback_is_checked(spark, monkeypatch):
    """A template that changes its first turn when there are 40 of them, far beyond what it declares."""
    def late(turns):
        return "".join(f"[{r}]{t}{'!' if n == 0 and len(turns) >= 40 else ''}\n" for n, (r, t) in enumerate(turns))

    template = chat.Template(late, lookback=1)
    segments = chat.format_turns(rows_of(spark, conversation(70)), template).orderBy("position").collect()
    assert [s.position for s in segments if s.rewritten] == [63]
    assert segments[63].segment == late(conversation(64))
    assert chat.digests(chat.format_turns(rows_of(spark, conversation(70)), template), template).first().rewritten
    # a conversation too long to be held is compared with its last turns only
    monkeypatch.setattr(chat, "WHOLE_CHARS", 200)
    state = chat._Rendering(template)
    assert not any(state.add(turn)[-1] for turn in conversation(70)) and len(state.turns) == 1


def test_a_declared_lookback_is_checked_at_any_length():
    """The same template in a conversation of 13 million characters."""
    def late(turns):
        return "".join(f"[{r}]{t}{'!' if n == 0 and len(turns) >= 40 else ''}\n" for n, (r, t) in enumerate(turns))

    state, long = chat._Rendering(chat.Template(late, lookback=1)), "long text " * 20_000
    found = [state.add((role, f"{n} {long}"))[-1] for n, (role, _) in enumerate(conversation(66))]
    assert [n for n, odd in enumerate(found) if odd] == [63]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\aim_end>\n", max_size=30))
def test_escapes_are_reversible_and_hide_control_strings(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_byte_pairs_of_odd_texts(spark):
    import tiktoken

    files = bpe_files()
    encoding = tiktoken.Encoding(
        "own", pat_str=files["pattern"], mergeable_ranks=byte_bpe.read_ranks(files["vocabulary"]), special_tokens={}
    )
    with open(files["vocabulary"], "rb") as file:
        encoder = byte_bpe._Encoder(file.read(), files["pattern"])

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
    def same(text):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)

    same()
    for text in ("<|endoftext|>", "a" * 20_000, " " * 5000 + "x", "\x00▁\U0001f600", "été " * 500):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)


def test_mixtures_are_told_apart():
    rng = np.random.default_rng(3)
    words = {"aa": ["kalo", "meri", "tuva", "sono"], "bb": ["grith", "wend", "skarp", "thorn"], "cc": ["zhou", "xian", "qing", "yuel"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    letters = language._letters()
    chances = np.full((language.BUCKETS, 3), 0.05)
    for n, lang in enumerate(words):
        np.add.at(chances[:, n], language.trigrams([say(lang, 2000)], letters)[0], 1)
    model = language.Model(tuple(words), chances / chances.sum(axis=0))
    texts = [say("aa", 50), say("aa", 60) + " " + say("bb", 30), "", "123", " ".join(say(k, 30) for k in words), "kalo"]
    shares = language.infer(texts, model, letters, 2.0)
    assert shares[0].tolist() == [1, 0, 0] and shares[2].sum() == shares[3].sum() == 0 and shares[5, 0] == 1
    assert shares[1].argmax() == 0 and 0.2 < shares[1, 1] < 0.45 and shares[1, 2] == 0
    assert (shares[4] > 0.2).all()


def test_pruned_lists_and_search_find_all_near_vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    chain = base[0] + np.linspace(0.03, 1.2, 40)[:, None] * base[1]  # a line of near vectors, where paths are long
    unit = vector_links._unit(list(np.vstack([base, base[:60] + rng.normal(scale=0.02, size=(60, 16)), chain])))
    distance = vector_links.distances(unit, unit[:0])
    assert (distance == distance.T).all()
    reach = 2 * np.sqrt(2 - 2 * 0.98) + vector_links.LOOSE
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    for alpha in (1.0, 1.2):
        lists = vector_links.prune(distance, alpha)
        for n, own in enumerate(lists):
            assert n not in own and len(set(own)) == len(own) and own[0] == np.argsort(distance[n] + 9 * (np.arange(400) == n))[0]
            # every other point is in the list or nearer to one of it
            assert ((alpha * distance[own].min(axis=0) < distance[n]) | np.isin(np.arange(400), own) | (np.arange(400) == n)).all()
        start, met = vector_links.medoid(unit), 0
        for n in range(400):
            found, steps = vector_links.search(unit, lists, start, n, reach)
            assert set(np.flatnonzero(near[n])) <= set(found) and n not in found and steps <= 45
            met += len(found)
        assert met < 0.5 * 400 * 399  # most pairs are never met


def test_dense_groups_split_over_shards_and_blocks_count_right(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=8)
    rows = [(n, (centre + rng.normal(scale=0.02, size=8)).tolist(), 1) for n in range(200)]
    rows += [(200 + n, rng.normal(size=8).tolist(), 1) for n in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_links.near_duplicates(df, target=40, cap=25).toPandas().set_index("vec_id")
    unit = vector_links._unit([np.float32(v) for _, v, _ in rows])
    true = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert got.audit_recall.iloc[0] == 1 and (got.n_links.sort_index().to_numpy() == true).all()


def test_every_pair_of_a_list_is_compared_once(spark):
    rng = np.random.default_rng(12)
    base = rng.integers(-(2**31), 2**31, (8, 6, 12))  # groups, variants of a coordinate's value, coordinates
    signatures = np.array([[base[n % 8, rng.integers(6), c] for c in range(12)] for n in range(160)])
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(signatures)], "node long, signature array<int>")
    lists: dict = {}
    for row in minhash_links._postings(df, 3).collect():
        lists.setdefault(row.token, []).append((row.node, row.earlier))
    compared: dict = {}
    for held in lists.values():
        for n, (a, x) in enumerate(held):
            for b, y in held[:n]:
                met = any(x >> c & y >> c & 1 for c in np.flatnonzero(signatures[a] == signatures[b]).tolist())
                pair = (min(a, b), max(a, b))
                compared[pair] = compared.get(pair, 0) + (not met)
    assert len(compared) > 1000 and set(compared.values()) == {1}


def test_links_of_short_texts_match_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"g{g}w{w}" for w in rng.permutation(12)[: rng.integers(8, 11)]) for g in range(25) for _ in range(14)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, low = [set(t.split()) for t in texts], list(range(len(texts)))

    def root(n):
        return n if low[n] == n else root(low[n])

    for a in range(len(texts)):
        for b in range(a - a % 14, a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    rows = minhash_links.near_duplicates(df, words=1, percent=80, rounds=1).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [root(n) for n in range(len(texts))]


def test_rare_links_between_many_clusters_are_all_found(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(3000, 32))
    near = base[:60] + rng.normal(scale=0.18, size=(60, 32)) * np.linalg.norm(base[:60], axis=1, keepdims=True) / np.sqrt(32)
    vectors = np.vstack([base, near]).astype("f4")
    df = spark.createDataFrame([(n, v.tolist(), 1) for n, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = vector_links.near_duplicates(df, target=100, cap=400, alpha=1.1).toPandas().set_index("vec_id").sort_index()
    unit = vector_links._unit(list(vectors))
    hits = unit @ unit.T >= 0.98
    np.fill_diagonal(hits, False)
    assert 30 < hits.sum() < 120 and got.audit_recall.iloc[0] == 1
    assert (got.n_links.to_numpy() == hits.sum(axis=1)).all()
    assert (got.component_id.to_numpy() == [min(n, *np.flatnonzero(hits[n])) if hits[n].any() else n for n in range(len(hits))]).all()


def test_searches_meet_visitors_too():
    """Points without a list, among which nothing is compared, are met by every partner at home."""
    rng = np.random.default_rng(21)
    unit = vector_links._unit(list(rng.normal(size=(30, 12))[rng.integers(0, 30, 400)] + rng.normal(scale=0.08, size=(400, 12))))
    near = unit @ unit.T >= 0.98
    reach = 2 * np.sqrt(2 - 2 * 0.98) + vector_links.LOOSE
    for alpha in (1.0, 1.15):
        lists = vector_links.prune(vector_links.distances(unit[:250], unit[250:]), alpha)
        start = vector_links.medoid(unit[:250])
        for n in range(250):
            found, _ = vector_links.search(unit, lists, start, n, reach)
            assert set(np.flatnonzero(near[n])) - {n} <= set(found)
    assert near[:250, 250:].sum() > 100


def test_groups_in_many_clusters_count_right(spark):
    rng = np.random.default_rng(22)
    centres = rng.normal(size=(40, 16))
    vectors = np.vstack([centres[n % 40] + rng.normal(scale=0.12, size=16) for n in range(1600)]).astype("f4")
    df = spark.createDataFrame([(n, v.tolist(), 1) for n, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    classes = vector_links._classes(df, "vec_id", "embedding", "label")[1]
    assert len(vector_links._pivots(classes, 40, 0.98)[("1", 16)]) >= 8
    got = vector_links.near_duplicates(df, target=40, cap=60).toPandas().set_index("vec_id").sort_index()
    unit = vector_links._unit(list(vectors))
    assert (got.n_links.to_numpy() == (unit @ unit.T >= 0.98).sum(axis=1) - 1).all() and got.n_links.sum() > 1000
    assert got.audit_recall.iloc[0] == 1


def test_vectors_alone_in_their_cluster_are_met_as_visitors(spark):
    """Each of two linked vectors is a pivot's only one; one visits the other's cluster."""
    rng = np.random.default_rng(23)
    base = rng.normal(size=(60, 48))
    vectors = np.vstack([base, base[:20] + rng.normal(scale=0.17, size=(20, 48))]).astype("f4")
    df = spark.createDataFrame([(n, v.tolist(), 1) for n, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    unit = vector_links._unit(list(vectors))
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert 10 < want.sum() < 40
    for target in (1, 3):
        got = vector_links.near_duplicates(df, target=target, cap=8).toPandas().set_index("vec_id").sort_index()
        assert (got.n_links.to_numpy() == want).all()


def test_a_dense_group_takes_one_pivot():
    rng = np.random.default_rng(17)
    dense = rng.normal(size=32) + rng.normal(scale=0.01, size=(500, 32))
    unit = vector_links._unit(list(np.vstack([dense, rng.normal(size=(20, 32))])))
    kept = vector_links.apart(unit, 0.98)
    assert len(kept) == 21 and (kept[0] == unit[0]).all()
