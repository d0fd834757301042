"""SQL for the checks: the same rules said once more, in DuckDB's dialect.

None of this is used by the operators.
"""

from __future__ import annotations

from shelfspark.functions.strings import BLANK, FOLD_FROM, FOLD_TO, TWO_LETTER_FOLDS

MARK = "chr(57344)"
WORD_CHARS = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{BLANK}+', ''), '{BLANK}+$', '')"


def fold(x: str) -> str:
    out = f"translate({x}, '{FOLD_FROM}', '{FOLD_TO}')"
    for letter, pair in TWO_LETTER_FOLDS.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return out


def _mark(x: str, before: str, joiners: str, after: str) -> str:
    return f"regexp_replace({x}, '({before})({joiners})({after})', '\\1' || {MARK} || '\\2\\3', 'g')"


def tokens(x: str) -> str:
    """Word tokens: joiners inside words and numbers are marked first (twice, as matches may touch)."""
    text = fold(f"lower({x})")
    for _ in range(2):
        text = _mark(text, r"[\p{L}\p{M}]", "[.:''·‘’]", r"\p{L}")
        text = _mark(text, r"\p{Nd}", "[.,;''‘’]", r"\p{Nd}")
    pattern = f"{WORD_CHARS}+(?:\\x{{E000}}.{WORD_CHARS}+)*"
    return f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda t: replace(t, {MARK}, ''))"


def letters(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '\p{{L}}+')"


def prefixes(x: str) -> str:
    words = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{Nd}}]+')"
    return (
        f"flatten(list_transform({words}, lambda w: "
        "list_transform(generate_series(1, least(20, length(w))), lambda n: substr(w, 1, n))))"
    )


def number(x: str) -> str:
    bare = rf"regexp_replace({strip(x)}, '(\d)_(\d)', '\1\2', 'g')"
    return (
        rf"CASE WHEN regexp_full_match({bare}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') "
        f"THEN TRY_CAST({bare} AS DOUBLE) END"
    )


def clean_price(x: str) -> str:
    return number(f"replace(replace({x}, '$', ''), ',', '')")


def bare_list(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\[\]]+', ''), '[\[\]]+$', '')"


def parsed_list(x: str) -> str:
    bare = f"replace({bare_list(x)}, '\"', '')"
    return (
        f"CASE WHEN {bare} <> '' THEN list_transform(string_split({bare}, ','), lambda s: {strip('s')}) "
        "ELSE CAST([] AS VARCHAR[]) END"
    )


def entities(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", "\xa0"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def visible_text(x: str) -> str:
    cut = "chr(1)"
    for pattern in (
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"(?s)<!--.*?-->",
        r"<[A-Za-z/!?][^>]*>",
    ):
        x = f"regexp_replace({x}, '{pattern}', {cut}, 'g')"
    strings = f"list_transform(string_split({x}, {cut}), lambda s: {strip(entities('s'))})"
    return f"array_to_string(list_filter({strings}, lambda s: s <> ''), chr(10))"


def title(x: str) -> str:
    raw = f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    return rf"trim(regexp_replace({entities(raw)}, '[\t\n\f\r ]+', ' ', 'g'))"


def json_block(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '(?s)\{{.*\}}', 0), '')"


def parsed_json(x: str) -> str:
    block = json_block(x)
    repaired = (
        rf"""regexp_replace(replace({block}, '''', '"'), '([\p{{L}}\p{{N}}_]+):', '"\1":', 'g')"""
    )
    return f"CASE WHEN json_valid({block}) THEN {block} WHEN json_valid({repaired}) THEN {repaired} END"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def bm25(
    docs: str, queries: str, boosts: dict[str, float], share: float, size: int, index=tokens, asked=tokens, prefix: str = ""
) -> str:
    """CTEs ending in `{prefix}ranked`: query_id, id, score, rank, by the textbook definition."""
    p = prefix
    fields = " UNION ALL ".join(
        f"SELECT '{f}' AS field, {b} AS boost, id, {index(f)} AS toks FROM {docs}" for f, b in boosts.items()
    )
    return f"""
{p}toks AS MATERIALIZED (SELECT * FROM ({fields}) u WHERE len(toks) > 0),
{p}stats AS (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_dl FROM {p}toks GROUP BY field),
{p}tf AS MATERIALIZED (
  SELECT field, boost, id, dl, term, count(*) AS tf
  FROM (SELECT field, boost, id, len(toks) AS dl, unnest(toks) AS term FROM {p}toks) e GROUP BY ALL),
{p}df AS (SELECT field, term, count(*) AS df FROM {p}tf GROUP BY field, term),
{p}asked AS (SELECT query_id, {asked("query")} AS toks FROM {queries}),
{p}clauses AS (SELECT query_id, len(toks) AS n, unnest(toks) AS term FROM {p}asked),
{p}field_scores AS (
  SELECT c.query_id, t.field, t.id, count(*) AS matched,
    round(sum(boost * 2.2 * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf
        / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score
  FROM {p}clauses c JOIN {p}tf t USING (term) JOIN {p}df d ON d.field = t.field AND d.term = t.term
    JOIN {p}stats s ON s.field = t.field
  GROUP BY c.query_id, t.field, t.id, c.n
  HAVING count(*) >= greatest(1, floor({share} * c.n + 1e-9))),
{p}best AS (SELECT query_id, id, max(score) AS score FROM {p}field_scores GROUP BY query_id, id),
{p}ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}best) r
  WHERE rank <= {size})"""


SEARCH = {"product_resume": 4.0, "title": 2.0, "description": 1.0}
RESUME = {"product_resume": 1.0}
