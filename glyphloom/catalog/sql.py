"""DuckDB SQL for the registered queries, written independently of the Spark plans.

The SQL is direct: whole streams are numbered by one window, losses are averaged over
materialized windows and batches.  It shows what the Spark plans must equal, not how.
"""

from __future__ import annotations

from glyphloom.functions.text import SPECIALS
from glyphloom.operators.epoch import PRIME, ROUNDS, round_keys

# White space and word characters as RE2 classes.
_WS = (r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
       r"\x{202f}\x{205f}\x{3000}]")
_WORD = r"[\p{L}\p{M}\p{N}\p{Nl}\p{Pc}\x{200c}\x{200d}]"
_OTHER = (r"[^\p{L}\p{M}\p{N}\p{Nl}\p{Pc}\x{200c}\x{200d}\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}"
          r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_PRETOKEN = f"{_WORD}+|{_OTHER}+"
_PRETOKEN_RAW = f"{_WS}|{_WORD}+|{_OTHER}+"

_SPLIT = ("CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' "
          "ELSE 'test' END")
_SPECIAL_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS id, '{t}' AS token" for i, t in enumerate(SPECIALS))
_SPECIAL_LIST = ", ".join(f"'{t}'" for t in SPECIALS)
_CONTEXT, _BATCH, _EPOCHS, _VOCAB = 128, 32, 5, 5000

_WORDS = f"""
docs AS (SELECT {_SPLIT} AS split, doc_id, text FROM documents),
lists AS (SELECT split, doc_id,
    list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS ts FROM docs),
words AS (SELECT split, doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos
    FROM lists)"""


def _vocab(where: str = "true") -> str:
    return f"""
counts AS (SELECT token, count(*) AS n, min((doc_id, pos)) AS first FROM words
    WHERE token NOT IN ({_SPECIAL_LIST}) AND {where} GROUP BY token),
vocab AS ({_SPECIAL_ROWS} UNION ALL
    SELECT CAST(row_number() OVER (ORDER BY n DESC, first) + 3 AS INTEGER) AS id, token
    FROM (SELECT * FROM counts ORDER BY n DESC, first LIMIT {_VOCAB - 4}))"""


_ENCODED = """
encoded AS (
    SELECT split, doc_id, CAST(pos AS INTEGER) AS pos, coalesce(id, 1) AS id
    FROM words LEFT JOIN vocab USING (token)
    UNION ALL SELECT split, doc_id, 0, 2 FROM docs
    UNION ALL SELECT split, doc_id, CAST(len(ts) + 1 AS INTEGER), 3 FROM lists)"""

# One stream per split: begin, every document's ids in order, end.
_WORD_STREAM = _WORDS + "," + _vocab("split = 'train'") + """,
ends AS (SELECT split, min(doc_id) AS lo, max(doc_id) AS hi FROM docs GROUP BY split),
w_items AS (
    SELECT split, doc_id, pos, coalesce(id, 1) AS id FROM words LEFT JOIN vocab USING (token)
    UNION ALL SELECT split, lo, -1, 2 FROM ends
    UNION ALL SELECT split, hi, 1000000000, 3 FROM ends),
w_stream AS (SELECT split, doc_id, id,
    row_number() OVER (PARTITION BY split ORDER BY doc_id, pos) - 1 AS pos FROM w_items),
w_size AS (SELECT count(*) AS v FROM vocab)"""


def _byte_stream(source: str = "docs") -> str:
    return f"""
b_ends AS (SELECT split, min(doc_id) AS lo, max(doc_id) AS hi FROM {source} GROUP BY split),
b_hex AS (SELECT split, doc_id, regexp_extract_all(hex(encode(
    text || CASE WHEN doc_id = hi THEN '' ELSE ' ' END)), '..') AS hs
    FROM {source} JOIN b_ends USING (split)),
b_items AS (
    SELECT split, doc_id, generate_subscripts(hs, 1) AS pos,
        CAST(('0x' || unnest(hs)) AS INTEGER) + 4 AS id FROM b_hex
    UNION ALL SELECT split, lo, -1, 2 FROM b_ends
    UNION ALL SELECT split, hi, 1000000000, 3 FROM b_ends),
b_stream AS (SELECT split, doc_id, id,
    row_number() OVER (PARTITION BY split ORDER BY doc_id, pos) - 1 AS pos FROM b_items),
b_size AS (SELECT 260 AS v)"""


def _pairs(t: str) -> str:
    return f"""
{t}_pairs AS (SELECT split, pos, cur, prev, slice FROM (SELECT split, pos, id AS cur,
    lag(id) OVER (PARTITION BY split ORDER BY pos) AS prev,
    CAST(('0x' || substr(md5('slice:' || doc_id), 1, 8)) AS BIGINT) % {_EPOCHS} AS slice
    FROM {t}_stream) WHERE prev IS NOT NULL)"""


def _model(t: str, staged: bool) -> str:
    """Counts of the final model (stage 0), or of every training stage."""
    stages = (f"(SELECT unnest(range({_EPOCHS})) AS stage)" if staged
              else "(SELECT 0 AS stage)")
    on = "slice <= stage" if staged else "true"
    return f"""
{t}_bi AS (SELECT stage, prev, cur, count(*) AS n FROM {t}_pairs JOIN {stages} ON {on}
    WHERE split = 'train' GROUP BY ALL),
{t}_ctx AS (SELECT stage, prev, sum(n) AS n_prev, count(*) AS seen FROM {t}_bi GROUP BY ALL),
{t}_uni AS (SELECT stage, cur, sum(n) AS n_cur FROM {t}_bi GROUP BY ALL),
{t}_all AS (SELECT stage, sum(n_cur) AS n_all, count(*) AS kinds FROM {t}_uni GROUP BY ALL)"""


def _scored(t: str, name: str, source: str) -> str:
    """``source`` joined to the counts, with the loss under both model types."""
    return f"""
{name} AS (SELECT p.*, a.stage, v, n_all, kinds, seen, n_prev, n_cur,
    -ln((coalesce(b.n, 0) + 1.0) / (coalesce(n_prev, 0) + v)) AS addk,
    -ln(0.75 * coalesce(b.n / n_prev, 0.0)
        + 0.25 * (coalesce(n_cur, 0) + 1.0) / (n_all + v)) AS interpolated,
    -ln(0.25 * (coalesce(n_cur, 0) + 1.0) / (n_all + v)) AS plain
    FROM {source} p CROSS JOIN {t}_size JOIN {t}_all a ON true
    LEFT JOIN {t}_bi b ON b.stage = a.stage AND b.prev = p.prev AND b.cur = p.cur
    LEFT JOIN {t}_ctx c ON c.stage = a.stage AND c.prev = p.prev
    LEFT JOIN {t}_uni u ON u.stage = a.stage AND u.cur = p.cur)"""


def _losses(t: str) -> str:
    """Mean of batch means over all windows, per split, stage and model type."""
    return f"""
{t}_long AS (SELECT split, stage, pos, cur, unnest(['addk', 'interpolated']) AS scorer,
    unnest([addk, interpolated]) AS nll FROM {t}_scored),
{t}_len AS (SELECT split, count(*) AS len FROM {t}_stream GROUP BY split),
{t}_win AS (SELECT split, stage, scorer, (pos - 1) // {_BATCH} AS batch, len, pos,
    avg(nll) OVER (PARTITION BY split, stage, scorer ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND {_CONTEXT - 1} FOLLOWING) AS loss
    FROM {t}_long JOIN {t}_len USING (split)),
{t}_batch AS (SELECT split, stage, scorer, batch, avg(loss) AS loss FROM {t}_win
    WHERE pos - 1 < len - {_CONTEXT} GROUP BY ALL),
{t}_mean AS (SELECT split, stage, scorer, avg(loss) AS nll FROM {t}_batch GROUP BY ALL),
{t}_plain AS (SELECT split, stage, scorer, avg(nll) AS nll_plain,
    avg(CASE WHEN cur = 1 THEN 1.0 ELSE 0.0 END) AS unk_rate, count(*) AS n_targets
    FROM {t}_long GROUP BY ALL),
{t}_text AS (SELECT split, sum(length(text)) AS chars, sum(strlen(text)) AS bytes
    FROM docs GROUP BY split)"""


_METRIC_SQL = """round(nll, 6) AS nll_token, round(exp(nll), 6) AS perplexity,
    round(nll / ln(2), 6) AS bits_per_token, round(nll * len / chars, 6) AS nll_per_char,
    round(nll * len / chars / ln(2), 6) AS bits_per_char,
    round(len / chars, 6) AS tokens_per_char,
    round(nll * len / bytes / ln(2), 6) AS bits_per_byte"""


def _metric_rows(t: str, name: str) -> str:
    return f"""SELECT '{name}' AS tokenizer, scorer, split, stage, {_METRIC_SQL},
    round(nll_plain, 6) AS nll_plain, round(unk_rate, 6) AS unk_rate, n_targets
    FROM {t}_mean JOIN {t}_plain USING (split, stage, scorer) JOIN {t}_len USING (split)
    JOIN {t}_text USING (split)"""


def _smooth(t: str, staged: bool) -> str:
    """Label-smoothed train loss, 0.9 of the loss and 0.1 of its mean over the vocabulary, as
    the mean of batch means over the windows in the order of each epoch."""
    return f"""
{t}_floor AS (SELECT stage, sum(-ln(0.25 * (n_cur + 1.0) / (n_all + v)))
        + (any_value(v) - any_value(kinds)) * any_value(-ln(0.25 * 1.0 / (n_all + v))) AS floor
    FROM {t}_uni JOIN {t}_all USING (stage) CROSS JOIN {t}_size GROUP BY stage),
{t}_bis AS (SELECT prev, cur, n, stage AS own FROM {t}_bi),
{_scored(t, t + "_seen", t + "_bis")},
{t}_spread AS (SELECT stage, prev,
    (sum(addk) + (any_value(v) - any_value(seen)) * any_value(-ln(1.0 / (n_prev + v))))
        / any_value(v) AS addk_mean,
    (sum(interpolated - plain) + any_value(floor)) / any_value(v) AS interpolated_mean
    FROM {t}_seen JOIN {t}_floor USING (stage) WHERE own = stage GROUP BY stage, prev),
{t}_whole AS (SELECT DISTINCT prev, cur FROM {t}_pairs WHERE split = 'train'),
{_scored(t, t + "_fit", t + "_whole")},
{t}_pair_loss AS (SELECT stage, prev, cur, unnest(['addk', 'interpolated']) AS scorer,
    unnest([0.9 * addk + 0.1 * coalesce(addk_mean, ln(v)),
            0.9 * interpolated + 0.1 * coalesce(interpolated_mean, floor / v)]) AS loss
    FROM {t}_fit JOIN {t}_floor USING (stage) LEFT JOIN {t}_spread USING (stage, prev)),
{t}_count AS (SELECT count(*) - {_CONTEXT} AS n FROM {t}_stream WHERE split = 'train'),
{_permuted(t + "_count", t, 5 if staged else 1)},
{t}_window_loss AS (SELECT stage, scorer, pos - 1 AS start, avg(loss) OVER (
        PARTITION BY stage, scorer ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_CONTEXT - 1} FOLLOWING)
    AS loss FROM {t}_pairs JOIN {t}_pair_loss USING (prev, cur) WHERE split = 'train'),
{t}_batch_loss AS (SELECT stage, scorer, place // {_BATCH} AS batch, avg(loss) AS loss
    FROM {t}_window_loss JOIN {t}_order ON start = number AND stage = epoch GROUP BY ALL),
{t}_train AS (SELECT stage, scorer, avg(loss) AS train_loss FROM {t}_batch_loss GROUP BY ALL)"""


def _permuted(counts: str, t: str, epochs: int) -> str:
    """Places of the numbers 0..n-1 in the order of each epoch; places outside walk on."""
    def one(source: str) -> str:
        for step in range(2 * ROUNDS):
            factor, summand = (
                "CASE epoch " + " ".join(f"WHEN {e} THEN {round_keys(42, e)[step][i]}"
                                         for e in range(epochs)) + " END" for i in (0, 1))
            name, other, size = ("r", "l", "b") if step % 2 else ("l", "r", "a")
            drawn = f"(({other} * ({factor}) + ({summand})) % {PRIME})"
            source = (f"SELECT * REPLACE (({name} + ({drawn} * {drawn}) % {PRIME}) % {size} AS {name}) "
                      f"FROM ({source})")
        return f"SELECT epoch, number, n, a, b, l * b + r AS place FROM ({source})"

    return f"""
{t}_grid AS (SELECT n, a, (n + a - 1) // a AS b
    FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM {counts})),
{t}_numbers AS (SELECT epoch, number, n, a, b, number // b AS l, number % b AS r FROM (
    SELECT *, unnest(range(0, n)) AS number FROM {t}_grid)
    CROSS JOIN (SELECT unnest(range(0, {epochs})) AS epoch)),
{t}_walk AS ({one(f"SELECT * FROM {t}_numbers")} UNION ALL {one(
    f"SELECT epoch, number, n, a, b, place // b AS l, place % b AS r FROM {t}_walk WHERE place >= n")}),
{t}_order AS (SELECT epoch, number, place FROM {t}_walk WHERE place < n)"""


def _run(t: str, staged: bool, where: str = "true") -> str:
    return ",".join([
        _pairs(t), _model(t, staged),
        f"\n{t}_asked AS (SELECT split, pos, prev, cur FROM {t}_pairs WHERE {where})",
        _scored(t, f"{t}_scored", f"{t}_asked"), _losses(t)])


_BOTH = f"WITH RECURSIVE {_WORD_STREAM}, {_byte_stream()}"
_RUNS = f"""{_BOTH}, {_run("w", False)}, {_run("b", False)},
runs AS ({_metric_rows("w", "word")} UNION ALL {_metric_rows("b", "byte")})"""
_EPOCH_ROWS = f"""{_BOTH}, {_run("w", True, "split = 'val'")}, {_smooth("w", True)},
{_run("b", True, "split = 'val'")}, {_smooth("b", True)},
records AS (
    SELECT r.*, train_loss FROM ({_metric_rows("w", "word")}) r
    JOIN w_train USING (stage, scorer)
    UNION ALL SELECT r.*, train_loss FROM ({_metric_rows("b", "byte")}) r
    JOIN b_train USING (stage, scorer))"""
_METRIC_NAMES = ("nll_token", "perplexity", "bits_per_token", "nll_per_char",
                 "bits_per_char", "tokens_per_char", "bits_per_byte")

# Byte-pair merges: symbols wrapped in two private-use marks, one step per merge.
_O, _C = "\ue000", "\ue001"


def _units(pattern: str) -> str:
    return f"""
pieces AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS us FROM documents),
occ AS (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS pos FROM pieces),
units AS (SELECT unit, count(*) AS n FROM occ GROUP BY unit)"""


def _age(symbol: str, made: int) -> str:
    """Ids order symbols: letters first by code point, then merges by age."""
    cases = " ".join(f"WHEN (SELECT a || b FROM m{i}) THEN {i}" for i in range(1, made + 1))
    return f"CASE {symbol} {cases} ELSE 0 END, {symbol}" if made else symbol


def _merge_steps(steps: int, source: str = "train_units") -> str:
    """CTEs m1..mN (one merge each) and s0..sN (the units after each)."""
    ctes = [f"""
s0 AS (SELECT n, '{_O}' || array_to_string(regexp_extract_all(unit, '(?s).'), '{_C}{_O}')
    || '{_C}' AS w FROM {source})"""]
    for i in range(1, steps + 1):
        ctes.append(f"""
m{i} AS (SELECT a, b FROM (SELECT n, unnest(list_zip(l[:-2], l[2:])) AS p, p[1] AS a, p[2] AS b
        FROM (SELECT n, string_split(substr(w, 2, length(w) - 2), '{_C}{_O}') AS l FROM s{i - 1}))
    GROUP BY a, b ORDER BY sum(n) DESC, {_age("a", i - 1)}, {_age("b", i - 1)} LIMIT 1),
s{i} AS (SELECT n, replace(w, '{_O}' || a || '{_C}{_O}' || b || '{_C}',
    '{_O}' || a || b || '{_C}') AS w FROM s{i - 1}, m{i})""")
    return ",".join(ctes)


def _merge_rows(steps: int) -> str:
    return " UNION ALL ".join(
        f'SELECT CAST({i - 1} AS INTEGER) AS rank, a AS "left", b AS "right" FROM m{i}'
        for i in range(1, steps + 1))


_LETTERS = """
letters AS (SELECT CAST(row_number() OVER (ORDER BY token) + 3 AS INTEGER) AS id, token
    FROM (SELECT DISTINCT unnest(regexp_extract_all(unit, '(?s).')) AS token
          FROM train_units))"""


def _bpe_ids(pattern: str, steps: int) -> str:
    """Ids of every document: the merges applied in order to each distinct unit."""
    word = (f"'{_O}' || array_to_string(regexp_extract_all(unit, '(?s).'), '{_C}{_O}') "
            f"|| '{_C}'")
    for i in range(1, steps + 1):
        word = (f"replace({word}, (SELECT '{_O}' || a || '{_C}{_O}' || b || '{_C}' FROM m{i}), "
                f"(SELECT '{_O}' || a || b || '{_C}' FROM m{i}))")
    known = " UNION ALL ".join(
        f"SELECT CAST((SELECT max(id) FROM letters) + {i} AS INTEGER), a || b FROM m{i}"
        for i in range(1, steps + 1))
    return f"""{_units(pattern)},
train_units AS (SELECT unit, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
    text, '{_PRETOKEN}')) AS unit FROM documents) GROUP BY unit),
{_LETTERS}, {_merge_steps(steps)},
tokens AS (SELECT id, token FROM letters UNION ALL {known}),
spelled AS (SELECT unit, string_split(substr(w, 2, length(w) - 2), '{_C}{_O}') AS l
    FROM (SELECT unit, {word} AS w FROM units)),
parts AS (SELECT unit, unnest(l) AS token, generate_subscripts(l, 1) AS k FROM spelled),
ids AS (SELECT unit, k, token, coalesce(id, 1) AS id FROM parts LEFT JOIN tokens USING (token)),
stream AS (SELECT doc_id, pos, k, id, token FROM occ JOIN ids USING (unit))"""


_BPE_ROWS = """SELECT doc_id, CAST(count(id) AS INTEGER) AS n_ids,
    coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, k), '') AS ids
    FROM (SELECT doc_id FROM documents) LEFT JOIN stream USING (doc_id) GROUP BY doc_id"""


# Characters and the 300 best pairs of characters as pieces, scored by their share.
_UNIGRAM = f"""{_units(_PRETOKEN)},
counted AS (SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, unnest(regexp_extract_all(unit, '(?s).')) AS piece FROM units) GROUP BY piece
    UNION ALL (SELECT piece, CAST(sum(n) AS BIGINT) FROM (
        SELECT n, substr(unit, i, 2) AS piece FROM (
            SELECT unit, n, unnest(range(1, length(unit))) AS i FROM units WHERE length(unit) > 1))
    GROUP BY piece HAVING sum(n) >= 2 ORDER BY 2 DESC, 1 LIMIT 300)),
given AS (SELECT piece, p, ln(p) AS s FROM (
    SELECT piece, n / sum(n) OVER () AS p FROM counted))"""


def _on(end: str) -> str:
    """The pieces of one and of two characters that end at a place."""
    return (f"JOIN given c ON c.piece = substr(unit, {end}, 1) "
            f"LEFT JOIN given d ON {end} > 1 AND d.piece = substr(unit, {end} - 1, 2)")


def _step(two_back: str, one_back: str) -> str:
    return f"{one_back} * c.p + {two_back} * coalesce(d.p, 0.0)"


def _window_rows(context: int, stride: int) -> str:
    return f"""WITH {_WORD_STREAM},
starts AS (SELECT split, pos AS start FROM w_stream
    JOIN (SELECT split, count(*) AS len FROM w_stream GROUP BY split) USING (split)
    WHERE pos < len - {context} AND pos % {stride} = 0),
cells AS (SELECT split, start, unnest(range(0, {context})) AS i FROM starts)
SELECT c.split, start, string_agg(CAST(x.id AS VARCHAR), ' ' ORDER BY i) AS x,
    string_agg(CAST(y.id AS VARCHAR), ' ' ORDER BY i) AS y
FROM cells c JOIN w_stream x ON x.split = c.split AND x.pos = start + i
JOIN w_stream y ON y.split = c.split AND y.pos = start + i + 1 GROUP BY c.split, start"""


_STARTS = f"""WITH RECURSIVE {_WORD_STREAM},
lens AS (SELECT split, count(*) AS len FROM w_stream GROUP BY split),
starts AS (SELECT split, pos AS start, len FROM w_stream JOIN lens USING (split)
    WHERE pos < len - {_CONTEXT})"""


def _score_rows(kind: str) -> str:
    return f"""WITH {_WORD_STREAM}, {_pairs("w")}, {_model("w", False)},
asked AS (SELECT split, prev, cur, count(*) AS n FROM w_pairs GROUP BY ALL),
{_scored("w", "scored", "asked")}
SELECT split, prev, cur, n, round({kind}, 6) AS nll FROM scored"""


def _decoded(words: str) -> str:
    return f"""SELECT doc_id, coalesce(string_agg({words}, ' ' ORDER BY pos), '') AS text"""


SQL: dict[str, str] = {
    "corpus_totals": f"""SELECT {_SPLIT} AS split, count(*) AS n_docs,
        CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
        FROM documents GROUP BY 1""",
    "first_rows": """SELECT doc_id, text FROM documents WHERE doc_id % 10 < 8
        ORDER BY doc_id LIMIT 100""",
    "seeded_split": """SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5('42:' || doc_id), 1, 8))
        AS BIGINT) % 10000 < 1000 THEN 'test' ELSE 'train' END AS split FROM documents""",
    "corpus_lines": "SELECT replace(text, chr(10), ' ') AS value FROM documents",
    "word_counts": f"""WITH {_WORDS} SELECT token, count(*) AS n, min(doc_id) AS first_doc
        FROM words GROUP BY token""",
    "word_vocab": f"WITH {_WORDS}, {_vocab()} SELECT id, token FROM vocab",
    "word_encode": f"""WITH {_WORDS}, {_vocab()}, {_ENCODED}
        SELECT doc_id, pos, id FROM encoded""",
    "word_encode_arrays": f"""WITH {_WORDS}, {_vocab()}, {_ENCODED}
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_ids,
        string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM encoded GROUP BY doc_id""",
    "word_decode": f"""WITH {_WORDS}, {_vocab()}, {_ENCODED}
        {_decoded("CASE WHEN id > 3 THEN token END")}
        FROM encoded JOIN vocab USING (id) GROUP BY doc_id""",
    "byte_encode": """WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS hs
        FROM documents), b AS (SELECT doc_id, generate_subscripts(hs, 1) AS pos,
        CAST(('0x' || unnest(hs)) AS INTEGER) + 4 AS id FROM h)
        SELECT doc_id, CAST(count(id) + 2 AS INTEGER) AS n_ids, '2 ' || coalesce(
        string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) || ' ', '') || '3' AS ids
        FROM (SELECT doc_id FROM documents) LEFT JOIN b USING (doc_id) GROUP BY doc_id""",
    "byte_decode": "SELECT doc_id, text FROM documents",
    "language_profile": f"""WITH {_WORDS}, {_vocab()},
        t AS (SELECT lang, count(*) AS n_tokens, count(*) FILTER (id IS NULL) AS n_unk
        FROM words JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
        LEFT JOIN vocab USING (token) GROUP BY lang),
        d AS (SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM documents GROUP BY lang)
        SELECT lang, n_docs, n_chars, n_tokens, round(n_tokens / n_chars, 6) AS tokens_per_char,
        round(n_unk / n_tokens, 6) AS unk_rate FROM t JOIN d USING (lang)""",
    "pretoken_counts": f"WITH {_units(_PRETOKEN)} SELECT unit, n FROM units",
    "alphabet": f"""WITH {_units(_PRETOKEN)}, train_units AS (SELECT * FROM units), {_LETTERS}
        SELECT id, token FROM letters""",
    "bpe_merges": f"""WITH {_units(_PRETOKEN)}, train_units AS (SELECT * FROM units),
        {_merge_steps(64)} {_merge_rows(64)}""",
    "bpe_vocab": f"""WITH {_units(_PRETOKEN)}, train_units AS (SELECT * FROM units),
        {_LETTERS}, {_merge_steps(64)}, made AS ({_merge_rows(64)})
        {_SPECIAL_ROWS} UNION ALL SELECT id, token FROM letters UNION ALL
        SELECT CAST(rank + 1 + (SELECT max(id) FROM letters) AS INTEGER), "left" || "right"
        FROM made""",
    "bpe_encode": f"WITH {_bpe_ids(_PRETOKEN, 8)} {_BPE_ROWS}",
    "bpe_encode_raw": f"WITH {_bpe_ids(_PRETOKEN_RAW, 8)} {_BPE_ROWS}",
    "bpe_decode": f"""WITH {_bpe_ids(_PRETOKEN, 8)}
        SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos, k), '') AS text
        FROM (SELECT doc_id FROM documents) LEFT JOIN stream USING (doc_id) GROUP BY doc_id""",
    "unigram_seed": f"""WITH {_units(_PRETOKEN)},
        heads AS (SELECT unit, n, unnest(range(1, length(unit))) AS i FROM units
            WHERE length(unit) > 1),
        cut AS (SELECT n, substr(unit, i, k) AS piece FROM (SELECT *, unnest(range(2,
            least(16, length(unit) - i + 1) + 1)) AS k FROM heads))
        SELECT piece, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) * length(piece) AS BIGINT) AS score
        FROM cut GROUP BY piece HAVING sum(n) >= 2 ORDER BY 3 DESC, 1 LIMIT 2000""",
    "unigram_expected": f"""WITH RECURSIVE {_UNIGRAM},
        ahead AS (SELECT unit, n, 0 AS t, 0.0::DOUBLE AS a0, 1.0::DOUBLE AS a1 FROM units
            UNION ALL SELECT unit, n, t + 1, a1, {_step("a0", "a1")} FROM ahead
            {_on("t + 1")} WHERE t < length(unit)),
        behind AS (SELECT unit, length(unit) AS t, 0.0::DOUBLE AS b2, 1.0::DOUBLE AS b1 FROM units
            UNION ALL SELECT b.unit, t - 1, b1, b1 * c.p + b2 * coalesce(d.p, 0.0) FROM behind b
            JOIN given c ON c.piece = substr(unit, t, 1)
            LEFT JOIN given d ON t < length(unit) AND d.piece = substr(unit, t, 2) WHERE t > 0),
        total AS (SELECT unit, a1 AS z FROM ahead WHERE t = length(unit)),
        uses AS (SELECT g.piece, x.n * x.a1 * g.p * y.b1 / z AS u FROM ahead x
            JOIN (SELECT unnest([1, 2]) AS k) ON t + k <= length(unit)
            JOIN given g ON g.piece = substr(x.unit, t + 1, k)
            JOIN behind y ON y.unit = x.unit AND y.t = x.t + k JOIN total ON total.unit = x.unit)
        SELECT piece, round(coalesce(sum(u), 0), 3) AS uses FROM given LEFT JOIN uses USING (piece)
        GROUP BY piece""",
    "unigram_given_encode": f"""WITH RECURSIVE {_UNIGRAM},
        ids AS (SELECT piece, CAST(row_number() OVER (ORDER BY s DESC, piece) + 3 AS INTEGER) AS id
            FROM given),
        best AS (SELECT unit, 0 AS t, CAST(NULL AS DOUBLE) AS s0, 0.0::DOUBLE AS s1,
            [] :: VARCHAR[] AS p0, [] :: VARCHAR[] AS p1 FROM units
            UNION ALL SELECT unit, t + 1, s1,
                CASE WHEN s0 + d.s >= s1 + c.s THEN s0 + d.s ELSE s1 + c.s END, p1,
                CASE WHEN s0 + d.s >= s1 + c.s THEN list_append(p0, d.piece)
                    ELSE list_append(p1, c.piece) END
            FROM best {_on("t + 1")} WHERE t < length(unit)),
        cut AS (SELECT unit, unnest(p1) AS piece, generate_subscripts(p1, 1) AS k FROM best
            WHERE t = length(unit)),
        coded AS (SELECT doc_id, pos, k, id FROM occ JOIN cut USING (unit) JOIN ids USING (piece))
        SELECT doc_id, CAST(count(id) AS INTEGER) AS n_ids,
        coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, k), '') AS ids
        FROM (SELECT doc_id FROM documents) LEFT JOIN coded USING (doc_id) GROUP BY doc_id""",
    "stream_positions": f"WITH {_WORD_STREAM} SELECT split, pos, id FROM w_stream",
    "lm_windows": _window_rows(8, 1),
    "lm_windows_stride16": _window_rows(128, 16),
    "lm_windows_full": f"""WITH {_WORD_STREAM},
        rows_of AS (SELECT split, pos, list(id) OVER (PARTITION BY split ORDER BY pos
            ROWS BETWEEN CURRENT ROW AND {_CONTEXT} FOLLOWING) AS ids FROM w_stream)
        SELECT split, pos AS start, md5(array_to_string(ids[1:{_CONTEXT}], ' ')) AS x,
            md5(array_to_string(ids[2:{_CONTEXT} + 1], ' ')) AS y
        FROM rows_of WHERE len(ids) = {_CONTEXT} + 1""",
    "split_sizes": f"""WITH {_WORD_STREAM} SELECT split, count(*) AS n_tokens,
        count(*) - {_CONTEXT} AS n_windows,
        CAST(ceil((count(*) - {_CONTEXT}) / {_BATCH}) AS BIGINT) AS n_batches
        FROM w_stream GROUP BY split""",
    "lm_batches": f"""{_STARTS}, w_count AS (SELECT count(*) AS n FROM starts WHERE split = 'train'),
        {_permuted("w_count", "w", 1)}
        SELECT split, start, CAST(start // {_BATCH} AS BIGINT) AS batch_id
        FROM starts WHERE split <> 'train' UNION ALL SELECT 'train', number,
        CAST(place // {_BATCH} AS BIGINT) FROM w_order""",
    "target_weights": f"""{_STARTS},
        sized AS (SELECT split, start // {_BATCH} AS b, count(*) AS k FROM starts GROUP BY ALL),
        nb AS (SELECT split, count(*) AS batches FROM sized GROUP BY split),
        won AS (SELECT s.split, start, 1.0 / k / batches / {_CONTEXT} AS w FROM starts s
            JOIN sized z ON z.split = s.split AND b = start // {_BATCH}
            JOIN nb ON nb.split = s.split),
        every AS (SELECT p.split, p.pos, sum(w) OVER (PARTITION BY p.split ORDER BY p.pos
            ROWS BETWEEN {_CONTEXT - 1} PRECEDING AND CURRENT ROW) AS w
            FROM w_stream p LEFT JOIN won ON won.split = p.split AND won.start = p.pos - 1
            WHERE p.pos >= 1)
        SELECT split, pos, round(w * batches * {_BATCH} * {_CONTEXT}, 6) AS n_windows
        FROM every JOIN nb USING (split)""",
    "word_bigrams": f"""WITH {_WORD_STREAM}, {_pairs("w")}
        SELECT split, prev, cur, count(*) AS n FROM w_pairs GROUP BY ALL""",
    "byte_bigrams": f"""WITH docs AS (SELECT {_SPLIT} AS split, doc_id, text FROM documents),
        {_byte_stream()}, {_pairs("b")}
        SELECT split, prev, cur, count(*) AS n FROM b_pairs GROUP BY ALL""",
    "conversation_bigrams": f"""WITH turns AS (SELECT 'train' AS split,
        conv_id * 1048576 + turn AS doc_id, text FROM conversations),
        {_byte_stream("turns")}, {_pairs("b")}
        SELECT split, prev, cur, count(*) AS n FROM b_pairs GROUP BY ALL""",
    "bigram_score": _score_rows("addk"),
    "interpolated_score": _score_rows("interpolated"),
    "smoothed_loss": f"""WITH RECURSIVE {_WORD_STREAM}, {_pairs("w")}, {_model("w", False)}, {_smooth("w", False)}
        SELECT scorer, round(train_loss, 6) AS train_loss FROM w_train""",
    "run_metrics": f"{_RUNS} SELECT * EXCLUDE (stage) FROM runs",
    "tokenizer_comparison": f"""{_RUNS} SELECT tokenizer, """ + ", ".join(
        f"max({m}) FILTER (scorer = '{s}') AS {s}_{m}"
        for s in ("addk", "interpolated") for m in _METRIC_NAMES) + """
        FROM runs WHERE split = 'test' GROUP BY tokenizer""",
    "saved_model_score": f"""WITH {_WORD_STREAM}, {_run("w", False, "split = 'val'")}
        SELECT * EXCLUDE (stage, tokenizer, scorer) FROM ({_metric_rows("w", "word")})
        WHERE scorer = 'addk'""",
    "epoch_records": f"""{_EPOCH_ROWS} SELECT tokenizer, scorer, CAST(stage AS INTEGER) AS epoch,
        split, {", ".join(_METRIC_NAMES)}, round(train_loss, 6) AS train_loss,
        nll_token AS val_loss, CAST(NULL AS DOUBLE) AS lr FROM records""",
    "curves": f"""{_EPOCH_ROWS} SELECT tokenizer, scorer, CAST(stage AS INTEGER) AS epoch,
        round(train_loss, 6) AS train_loss, nll_token AS val_loss FROM records""",
    "curve_summary": f"""{_EPOCH_ROWS} SELECT tokenizer, scorer, count(*) AS n_epochs,
        round(min(least(train_loss, nll_token)), 6) AS low,
        round(max(greatest(train_loss, nll_token)), 6) AS high FROM records GROUP BY ALL""",
}

SQL["result_files"] = SQL["epoch_records"]
