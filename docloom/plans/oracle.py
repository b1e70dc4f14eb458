"""DuckDB SQL for the queries of the catalog, over the same tables."""

from __future__ import annotations

from docloom.functions.classify import ACADEMIC, BOOK, BOOK_PATTERNS, BOOK_TYPES, DRUG_WORDS, NOVEL_WORDS, PAPER, UNSUITABLE
from docloom.functions.splitters import LOOK_AHEAD, MANUAL, NOVEL, REFERENCE_BOOK, TEXTBOOK
from docloom.functions.text import ABSTRACT_PREFIX, MASKS, PROMPT_HEAD, PROMPT_QUESTION, STOP_WORDS
from docloom.config import EngineConfig
from docloom.operators.chunking import ACADEMIC_HEADS, DRUG_LABELS, REFERENCE_START, SENTENCE, SENTENCE_END
from docloom.operators.filters import PLACEHOLDERS
from docloom.operators.sections import HEADING, PAGE_LINE

CONFIG = EngineConfig()


#: Headings for the splitters of books, which the test tables lack.
TITLES = {
    "textbook": ("第一章 绪论", "1.2 Basics of it", "例题 3 a case", "本章小结", "思考题"),
    "novel": ("第二回 归来", "人物", "***", "场景", "---", "尾声"),
    "manual": ("1. Open the lid", "Step 2: close it", "WARNING", "TIP", "步骤", "FAQ"),
    "reference": ("Term: a word", "Definition 4", "Theorem 5", "Exercise 6", "References"),
    "main": ("1 Scope of it", "2.1 Methods", "3 Results"),
}
WHOLE = "SELECT doc_id, 0 AS part, text AS t FROM documents"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"


def deidentify(x: str) -> str:
    for pattern, mask in MASKS:
        x = sub(x, pattern.replace(r"\d", "[0-9]"), lit(mask))
    return x


def abstract(x: str) -> str:
    words = f"regexp_extract_all(lower(substring({strip(sub(x, r'\s+', lit(' ')))}, 1, 500)), '[A-Za-z]+')"
    kept = f"list_filter({words}, lambda w: w NOT IN ({', '.join(map(lit, STOP_WORDS))}))"
    return f"{lit(ABSTRACT_PREFIX)} || array_to_string(list_slice({kept}, 1, 18), ' ')"


def pack(pieces: str, size: int, joiner: str, slack: int, opens: str = "false") -> str:
    """A fold over the pieces; chunks as a list. A piece for which `opens` holds starts a chunk."""
    fits = f"(length(a.cur) + length(x) + {slack} <= {size} AND NOT ({opens}))"
    fold = (
        f"list_reduce({pieces}, lambda a, x: {{'done': CASE WHEN {fits} OR a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END, "
        f"'cur': CASE WHEN {fits} AND a.cur <> '' THEN a.cur || {joiner} || x ELSE x END}}, {{'done': []::VARCHAR[], 'cur': ''}})"
    )
    return closed(fold)


def closed(fold: str) -> str:
    return f"list_transform([{fold}], lambda r: CASE WHEN r.cur = '' THEN r.done ELSE list_append(r.done, r.cur) END)[1]"


def kept(pieces: str) -> str:
    return f"list_filter(list_transform({pieces}, lambda x: {strip('x')}), lambda x: x <> '')"


def sentences(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, {lit(SENTENCE)}), lambda s: {strip(sub('s', SENTENCE_END, lit('')))} <> '')"


def lines_packed(x: str, size: int = 500) -> str:
    blocks = f"string_split_regex(array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), chr(10)), '\\n{{2,}}')"
    return f"flatten(list_transform({blocks}, lambda b: {pack(kept('string_split(b, chr(10))'), size, 'chr(10)', 2)}))"


def chunked(expression: str, source: str = "(SELECT doc_id, text AS t FROM documents)") -> str:
    return f"""SELECT doc_id, chunk_index::INT AS chunk_index, sha1(chunk) AS chunk_sha1, length(chunk)::BIGINT AS n_chars
FROM (SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_index, unnest(c) AS chunk FROM (SELECT doc_id, {expression} AS c FROM {source}))"""


def top(source: str, k: int, query: str = "query_id", columns: str = "query_id, seg_id, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, (row_number() OVER (PARTITION BY {query} ORDER BY score DESC, seg_id))::INT AS rank FROM ({source})) WHERE rank <= {k}"


def tfidf(question_text: str = "text", k: int = 20, ngram_max: int = 1, min_df: int = 1) -> str:
    def counted(source: str) -> str:
        grams = "w" if ngram_max == 1 else "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
        return rf"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({grams}) AS term FROM (SELECT id, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM ({source}))) GROUP BY ALL"

    return f"""SELECT query_id, seg_id, score, rank FROM (
WITH c AS ({counted("SELECT doc_id AS id, text AS t FROM documents")}),
v AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf, count(*) AS df FROM c GROUP BY term HAVING count(*) >= {min_df}),
dw AS (SELECT id, term, tf * idf AS w FROM c JOIN v USING (term)),
dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dw GROUP BY id),
q AS ({counted(f"SELECT item_id AS id, {question_text} AS t FROM benchmark")}),
qw AS (SELECT id, term, tf * idf AS w FROM q JOIN v USING (term)),
qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qw GROUP BY id),
hits AS (SELECT qw.id AS query_id, dw.id AS seg_id, round(sum(qw.w / qn.n * dw.w / dn.n), 6) AS score
  FROM qw JOIN qn ON qn.id = qw.id JOIN dw USING (term) JOIN dn ON dn.id = dw.id GROUP BY 1, 2),
everything AS (SELECT b.item_id AS query_id, d.doc_id AS seg_id, coalesce(h.score, 0.0) AS score
  FROM benchmark b CROSS JOIN documents d LEFT JOIN hits h ON h.query_id = b.item_id AND h.seg_id = d.doc_id)
{top("SELECT * FROM everything", k)})"""


def dense(k: int) -> str:
    return top("SELECT q.vec_id AS query_id, v.vec_id AS seg_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN embeddings v", k)


def minmax(source: str) -> str:
    return f"SELECT query_id, seg_id, round(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM ({source}))"


def fused(sparse: str) -> str:
    return f"SELECT query_id, seg_id, round(sum(part), 8) AS score FROM (SELECT query_id, seg_id, norm * 0.65::DOUBLE AS part FROM ({minmax(dense(8))}) UNION ALL SELECT query_id, seg_id, norm * 0.35::DOUBLE FROM ({minmax(sparse)})) GROUP BY 1, 2"


def boosted(sparse: str) -> str:
    raised = f"SELECT query_id, seg_id, round(score * CASE WHEN seg_id % 5 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END, 10) AS score FROM ({top(fused(sparse), 24)}) JOIN (SELECT doc_id AS seg_id FROM documents) USING (seg_id)"
    return top(raised, 8)


def like_any(x: str, words) -> str:
    return " OR ".join(f"contains({x}, {lit(w)})" for w in words)


def count_of(x: str, words) -> str:
    return " + ".join(f"contains({x}, {lit(w)})::INT" for w in words)


MARKED = """(SELECT doc_id, CASE WHEN doc_id % 16 < 8 THEN mark || text ELSE substring(text, 1, 1900) || mark || substring(text, 1901) END AS t
 FROM (SELECT doc_id, text, (['', ' 目录 前言 ', ' Abstract: x ', ' 第一章 习题 ', ' 小说 Copyright © ', ' 摘要 关键词 目录 前言 ', ' 手册 本书 读者 ', ' 药 '])[doc_id % 8 + 1] AS mark FROM documents))"""
IS_ACADEMIC = f"({like_any('substring(t, 1, 2000)', ACADEMIC)})"
IS_BOOK = (
    f"(NOT (({count_of('substring(t, 1, 3000)', PAPER)}) >= 2 OR {IS_ACADEMIC}) AND (({count_of('substring(t, 1, 3000)', BOOK)}) >= 2 OR "
    f"({' + '.join(f'regexp_matches(substring(t, 1, 3000), {lit(p)})::INT' for p in BOOK_PATTERNS)}) >= 2))"
)
#: Of whole texts, as the operator takes them; routing looks at the beginning alone.
IS_BOOK_WHOLE = (
    f"(NOT (({count_of('substring(t, 1, 3000)', PAPER)}) >= 2 OR {IS_ACADEMIC}) AND (({count_of('t', BOOK)}) >= 2 OR "
    f"({' + '.join(f'regexp_matches(t, {lit(p)})::INT' for p in BOOK_PATTERNS)}) >= 2))"
)
POLICY = "(['Where can I get a refund for the parking fee', 'I will sue the clinic in court', 'Please give me the doctor phone number', 'Can I fake the form to bypass the line', 'What are the rules about suing', 'Is there a rule on personal info and billing', 'When can I shower after the operation', 'A regulation says the physician  address is public'])[o_orderkey % 8 + 1] || ' ' || o_orderkey"
PAGES = """(SELECT source AS file_name, doc_id AS page_no, CASE WHEN doc_id % 3 = 0 THEN 'Page 1 of 9' || chr(10)
 || CASE WHEN doc_id % 7 = 0 THEN '1.2.3.4.' || doc_id % 3 ELSE (doc_id % 5 + 1) || '.' || doc_id % 2 END || ' '
 || CASE WHEN doc_id % 11 = 0 THEN 'ab' ELSE 'Scope of part' END || chr(10) || text ELSE text END AS text FROM documents)"""
REVIEWS = """(SELECT user_id AS request_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'replace' ELSE 'other' END AS action,
 CASE WHEN event_id % 2 = 0 THEN 'draft ' || event_id END AS draft, CASE WHEN event_id % 3 <> 0 THEN 'text ' || event_id END AS final_text FROM events)"""
NORMAL_RAW = r"(chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || replace(text, '. ', '.-' || chr(10) || ' ' || chr(10) || chr(10) || chr(10)) || 'well-' || chr(10) || 'known é-' || chr(10) || 'op ' || chr(10) || ' ')"
WINDOWS = f"(CASE WHEN length(text) <= 2200 THEN [text] ELSE list_filter(list_transform(range(0, ceil((length(text) - 2200) / 2000)::BIGINT + 1), lambda i: {strip('substring(text, i * 2000 + 1, 2200)')}), lambda x: x <> '') END)"


def normalize(x: str) -> str:
    out = sub(f"replace({x}, chr(13), chr(10))", r"\n{3,}", "chr(10) || chr(10)")
    return strip(sub(sub(out, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"'\1\2'"), r"\s+\n", "chr(10)"))


def reviewed(events: str) -> str:
    return f"""(SELECT o.request_id, o.seq, o.draft, CASE WHEN d.d IS NULL THEN 'PENDING' WHEN d.d.action = 'approve' THEN 'APPROVED' ELSE 'REPLACED' END AS status,
 CASE d.d.action WHEN 'approve' THEN d.d.final_text WHEN 'replace' THEN {lit(CONFIG.refer_message)} END AS final_text
 FROM (SELECT request_id, min(seq) AS seq, arg_min_null(draft, seq) AS draft FROM {events} WHERE action = 'enqueue' GROUP BY 1) o
 LEFT JOIN (SELECT e.request_id, arg_max(struct_pack(action := action, final_text := final_text), e.seq) AS d FROM {events} e
   JOIN (SELECT request_id, min(seq) AS s FROM {events} WHERE action = 'enqueue' GROUP BY 1) f ON f.request_id = e.request_id AND e.seq > f.s
   WHERE action IN ('approve', 'replace') GROUP BY 1) d ON d.request_id = o.request_id)"""


def headings() -> str:
    lines = f"list_filter(list_transform(string_split({normalize('text')}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, {lit(PAGE_LINE)}) AND length(regexp_extract(x, {lit(HEADING)}, 2)) >= 3)"
    found = f"SELECT file_name, page_no, regexp_extract(l, {lit(HEADING)}, 1) AS section_id, regexp_extract(l, {lit(HEADING)}, 2) AS section_title FROM (SELECT file_name, page_no, {lines}[1] AS l FROM {PAGES}) WHERE l IS NOT NULL"
    return f"""SELECT file_name, page_no, section_id, section_title FROM (
 SELECT *, lag(section_id || '|' || section_title) OVER (PARTITION BY file_name ORDER BY page_no) AS b FROM ({found}) WHERE length(section_id) - length(replace(section_id, '.', '')) <= 3)
 WHERE b IS NULL OR b <> section_id || '|' || section_title"""


def cleaned(x: str) -> str:
    """For pages without nesting of dropped elements, as the test pages are; nested ones are compared with rows by hand."""
    x = sub(x, r"(?s)<!--.*?-->|<![^>]*>", "chr(1)")
    for tag in ("script", "style", "nav", "footer", "iframe", "aside", "header", "meta", "link"):
        x = sub(x, rf"(?is)<{tag}\b[^>]*>" if tag in ("meta", "link") else rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "chr(1)")
    x = sub(x, "<[^>]*>", "chr(1)")
    for name, character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(character)})"
    return f"array_to_string({kept(f'string_split({x}, chr(1))')}, chr(10))"


def paragraphs(text: str = "replace(t, chr(10), chr(10) || chr(10))") -> str:
    fits = "length(a.cur) + length(x) + 2 <= 500"
    parts = pack(sentences("x"), 500, "''", 0)
    done = "CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END"
    fold = (
        f"list_reduce({kept(rf'''string_split_regex({text}, '\n\s*\n')''')}, lambda a, x: {{'done': CASE WHEN {fits} THEN a.done WHEN length(x) <= 500 THEN {done} "
        f"ELSE list_concat({done}, list_slice({parts}, 1, -2)) END, 'cur': CASE WHEN {fits} AND a.cur = '' THEN x WHEN {fits} THEN a.cur || chr(10) || chr(10) || x WHEN length(x) <= 500 THEN x "
        f"ELSE coalesce(({parts})[-1], a.cur) END}}, {{'done': []::VARCHAR[], 'cur': ''}})"
    )
    return closed(fold)


def default_packed() -> str:
    fits = "length(a.cur) + length(x) <= 500"
    fold = f"list_reduce(string_split(t, chr(10)), lambda a, x: {{'done': CASE WHEN {fits} OR a.cur = '' THEN a.done ELSE list_append(a.done, {strip('a.cur')}) END, 'cur': CASE WHEN {fits} THEN a.cur || chr(10) || x ELSE x END}}, {{'done': []::VARCHAR[], 'cur': ''}})"
    return f"list_transform([{fold}], lambda r: CASE WHEN r.cur = '' THEN r.done ELSE list_append(r.done, {strip('r.cur')}) END)[1]"


def academic() -> str:
    lines = kept("string_split(t, chr(10))")
    whole = "CASE WHEN a.body = '' THEN a.done ELSE list_append(a.done, CASE WHEN a.title = '' THEN a.body ELSE a.title || chr(10) || a.body END) END"
    head = f"regexp_matches(x, {lit(ACADEMIC_HEADS)})"
    fold = f"list_reduce({lines}, lambda a, x: {{'done': CASE WHEN {head} THEN {whole} ELSE a.done END, 'title': CASE WHEN {head} THEN '【' || regexp_extract(x, {lit(ACADEMIC_HEADS)}, 1) || '】' ELSE a.title END, 'body': CASE WHEN {head} THEN '' WHEN a.body = '' THEN x ELSE a.body || chr(10) || x END}}, {{'done': []::VARCHAR[], 'title': '', 'body': ''}})"
    sections = f"list_transform([{fold}], lambda a: {whole})[1]"
    packed = f"flatten(list_transform(s, lambda y: CASE WHEN length(y) <= 500 THEN [y] ELSE {lines_packed('y')} END))"
    return f"list_transform([{sections}], lambda s: CASE WHEN len(s) = 0 THEN {lines_packed('t')} ELSE {packed} END)[1]"


def hashed(rows: str) -> str:
    """(doc_id, part, pos, chunk) -> the chunks' numbers and digests."""
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1)::INT AS chunk_index, sha1(chunk) AS chunk_sha1, length(chunk)::BIGINT AS n_chars FROM ({rows}) WHERE chunk <> ''"


def length_rows(source: str, size: int = 500, overlap: int = 50) -> str:
    """source(doc_id, part, t) -> (doc_id, part, pos, chunk): one window after the other."""

    def end(at: str) -> str:
        ahead = f"substring(t, {at} + {size + 1}, {LOOK_AHEAD})"
        skip = f"length(regexp_extract({ahead}, '^[^ 。！？,，;；\\n\\t]*'))"
        return f"{at} + {size} + CASE WHEN {skip} < length({ahead}) THEN {skip} + 1 ELSE 0 END"

    return f"""SELECT doc_id, part, pos, {strip("substring(t, pos + 1, nxt - pos)")} AS chunk FROM (WITH RECURSIVE w AS (
 SELECT doc_id, part, t, 0::BIGINT AS pos, ({end("0")})::BIGINT AS nxt FROM ({source}) WHERE length(t) > 0
 UNION ALL SELECT doc_id, part, t, nxt - {overlap}, {end(f"(nxt - {overlap})")} FROM w WHERE nxt - {overlap} < length(t)) SELECT * FROM w)"""


def tail(x: str, overlap: int) -> str:
    """What the next chunk repeats of x: behind the last sentence end that leaves enough, else its last characters."""
    target = f"least({overlap}, length({x}) // 3)"
    behind = strip(f"substring({x}, i + 2)")
    places = f"list_filter(range(greatest(0, length({x}) - {target} - {LOOK_AHEAD}) + 1, length({x})), lambda i: contains('。！？.!?', substring({x}, i + 1, 1)) AND length({behind}) >= {target} // 2)"
    last = strip(f"right({x}, {target})")
    return f"CASE WHEN length({x}) < 20 THEN '' WHEN len({places}) > 0 THEN {strip(f'substring({x}, list_max({places}) + 2)')} ELSE regexp_replace({last}, '^[,，;；.。!！?？]\\s*', '') END"


def sentence_rows(source: str, size: int = 500, overlap: int = 50) -> str:
    """source(doc_id, part, t) -> (doc_id, part, pos, chunk): sentences packed chunk by chunk; each chunk looks at the
    one before the last."""

    def next_end(at: str, lead: str) -> str:
        room = f"{size + 1} - CASE WHEN {lead} = '' THEN 0 ELSE length({lead}) + 1 END"
        return f"greatest({at} + 1, len(list_filter(total, lambda x: x <= total[{at} + 1] + {room})) - 1)"

    found = kept(r"""regexp_extract_all(t, '[^。！？.?!]*[。！？.?!]+[」》”"]?\s*')""")
    base = f"(SELECT doc_id, part, t, found, list_transform(range(0, len(found) + 1), lambda i: coalesce(list_sum(list_transform(list_slice(found, 1, i), lambda x: length(x) + 1)), 0)::BIGINT) AS total FROM (SELECT *, {found} AS found FROM ({source})))"
    return f"""SELECT doc_id, part, pos, chunk FROM (WITH RECURSIVE c AS (
 SELECT doc_id, part, found, total, 0::BIGINT AS pos, nxt, 0::BIGINT AS k, array_to_string(list_slice(found, 1, nxt), ' ') AS chunk, '' AS prev FROM (SELECT *, ({next_end("0", "''")})::BIGINT AS nxt FROM {base}) WHERE len(found) > 1
 UNION ALL SELECT doc_id, part, found, total, nxt, stop, k + 1, CASE WHEN lead = '' THEN '' ELSE lead || ' ' END || array_to_string(list_slice(found, nxt + 1, stop), ' '), chunk
 FROM (SELECT *, ({next_end("nxt", "lead")})::BIGINT AS stop FROM (SELECT *, CASE WHEN k >= 1 THEN {tail("prev", overlap)} ELSE '' END AS lead FROM c WHERE nxt < len(found)))) SELECT * FROM c)
 UNION ALL {length_rows(f"SELECT doc_id, part, t FROM (SELECT doc_id, part, t, {found} AS found FROM ({source})) WHERE len(found) <= 1", size, overlap)}"""


def headed(heads: tuple[str, ...], every: int) -> str:
    """Documents with headings before some of their lines."""
    listed = "[" + ", ".join(map(lit, heads)) + "]"
    return f"(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1 + doc_id) % {every} = 1 THEN ({listed})[(i - 1 + doc_id) // {every} % {len(heads)} + 1] || chr(10) || l ELSE l END), chr(10)) AS t FROM documents)"


def titled_list(name: str, patterns: tuple[str, ...], breaks: bool) -> str:
    pattern = "|".join(patterns)
    pieces = kept(f"string_split(regexp_replace(t, {lit(f'({pattern})')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))")
    rule = r"'^[*\-]{3,}$'"
    opens = f"regexp_matches(x, {lit(f'^(?:{pattern})')})" if breaks else f"regexp_matches(x, {rule}) OR regexp_matches(a.cur, {rule})"
    return pack(pieces, 500, "chr(10)", 2, opens)


def titled(name: str, patterns: tuple[str, ...], breaks: bool) -> str:
    return chunked(titled_list(name, patterns, breaks), headed(TITLES[name], 2))


def main_parts() -> str:
    source = headed(TITLES["main"], 4)
    chapters = r"string_split(regexp_replace(t, '(\n[0-9]+(?:\.[0-9]+)*\s+[^\n]+)', chr(1) || '\1', 'g'), chr(1))"
    rows = f"SELECT doc_id, unnest(list_slice(p, 2, len(p))) AS t, unnest(range(1, len(p))) AS part FROM (SELECT doc_id, {chapters} AS p FROM {source}) WHERE len(p) > 2"
    rows = f"SELECT doc_id, part, {strip('t')} AS t FROM ({rows})"
    whole = f"SELECT doc_id, generate_subscripts(c, 1) AS part, 0 AS pos, unnest(c) AS chunk FROM (SELECT doc_id, {paragraphs('t')} AS c FROM {source} WHERE len({chapters}) <= 2)"
    return hashed(f"SELECT doc_id, part, 0 AS pos, t AS chunk FROM ({rows}) WHERE length(t) <= 500 UNION ALL {sentence_rows(f'SELECT * FROM ({rows}) WHERE length(t) > 500')} UNION ALL {whole}")


def references() -> str:
    items = kept(f"string_split_regex(t, {lit(REFERENCE_START)})")
    joined = "array_to_string(list_transform(list_slice(it, g * 5 + 1, g * 5 + 5), lambda x, j: '[' || j || '] ' || x), chr(10))"
    single = "list_transform(list_slice(it, g * 5 + 1, g * 5 + 5), lambda x, j: '[' || (g * 5 + j) || '] ' || x)"
    return f"list_transform([{items}], lambda it: flatten(list_transform(range(0, (len(it) + 4) // 5), lambda g: CASE WHEN length({joined}) > 500 THEN {single} ELSE [{joined}] END)))[1]"


#: Written out for the SQL, apart from the operator's own.
PUNCTUATION_CLASS = r"[，。！？；：「」『』（）【】《》〈〉、·!-/:-@\[-`{-~ \t\n\r]"
VALID_CLASS = "[一-鿿a-zA-Z0-9]"
KEEP = f"(length(s) >= 15 AND 1 - (length(s) - len(regexp_extract_all(s, {lit(PUNCTUATION_CLASS)}))) / greatest(length(s), 1) <= 0.8 AND len(regexp_extract_all(s, {lit(VALID_CLASS)})) / greatest(length(s), 1) >= 0.3 AND NOT ({like_any('lower(s)', sorted({p.lower() for p in PLACEHOLDERS}))}))"
CONTAINED = (
    f"list_reduce(list_filter(list_transform(string_split_regex(text, '[.,]'), lambda c: {strip('c')}), lambda s: {KEEP}), lambda a, x: "
    "CASE WHEN len(a) = 0 OR NOT (contains(a[-1], x) OR contains(x, a[-1])) THEN list_append(a, x) WHEN length(x) > length(a[-1]) THEN list_append(a[:-2], x) ELSE a END, []::VARCHAR[])"
)
LOCAL = "'[LOCAL:' || source || ':' || (2015 + doc_id % 10) || '] ' || text"
LINKS = r"""WITH h AS (SELECT url, regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*"([^"]*)"', 1) AS hs FROM pages),
a AS (SELECT url, list_transform(hs, lambda x: replace(x, '&amp;', '&')) AS hs, regexp_extract(url, '^(https?):', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, regexp_replace(url, '[?#].*$', '') AS plain FROM h),
b AS (SELECT *, CASE WHEN regexp_matches(plain, '^https?://[^/]*$') THEN plain || '/' ELSE regexp_replace(plain, '[^/]*$', '') END AS folder FROM a),
c AS (SELECT url, list_filter(list_transform(hs, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x WHEN starts_with(x, '/') THEN root || x
 WHEN x = '' THEN url WHEN starts_with(x, '#') THEN regexp_replace(url, '#.*$', '') || x WHEN starts_with(x, '?') THEN plain || x ELSE folder || x END),
 lambda l: regexp_extract(l, '^https?://([^/?#]*)', 1) = regexp_extract(url, '^https?://([^/?#]*)', 1)) AS ls FROM b),
u AS (SELECT url, row_number() OVER () AS rid, list_concat([url], ls) AS ls FROM c),
e AS (SELECT rid, url, unnest(ls) AS link, generate_subscripts(ls, 1) AS p FROM u),
f AS (SELECT rid, url, link, min(p) AS p FROM e GROUP BY ALL)
SELECT url, ord::INT AS ord, link FROM (SELECT url, link, row_number() OVER (PARTITION BY rid ORDER BY p) - 1 AS ord FROM f) WHERE ord <= 5"""

SITE_URL = "'http://h' || page_id % 7 || '.example/p' || page_id"
SITE_HTML = """'<a href="/p' || (page_id + 7) || '">x</a> <a href="http://h' || (page_id + 1) % 7 || '.example/p' || (page_id + 1) || '">x</a> <a href="/p' || (page_id + 14) || '">x</a> <a href="/p' || (page_id + 7) || '">x</a> ' || html"""

#: Pages and what a parser shows of them, by hand; a page's number follows each.
CLEAN_CASES = (
    ("<aside>a<aside>b</aside>c</aside>d", "d"),
    ("<nav><nav>x</nav>LEAK</nav>y", "y"),
    ("&eacute;&#233;&#xe9;&mdash;&amp;lt;", "éé" + "é—&lt;"),
    ("one<!-- > two -->three", "one\nthree"),
    ("<p title='a > b'>p</p></nav>q", "p\nq"),
    ("<div><footer>f</div>g", "g"),
    ("<SCRIPT>if (a < b) x = '</p>';</SCRIPT>h", "h"),
    ("<ul><li>i<li>j</ul><br/>k", "i\nj\nk"),
    ("<header>l<p>m</header>n</p>o", "n\no"),
    ("<meta name=x>r<link rel=y>s", "r\ns"),
)
#: Links on {R}{D}/e?q=1#t, where {D} is /a/d and a number, and what they lead to, by hand.
LINK_CASES = (
    ("../b", "{R}/a/b"), ("./c", "{R}{D}/c"), ("../../../z", "{R}/z"), ("/x/./y/../w", "{R}/x/w"), ("?k=2", "{R}{D}/e?k=2"), ("#s", "{R}{D}/e?q=1#s"), ("", "{R}{D}/e?q=1#t"), ("..", "{R}/a/"), (".", "{R}{D}/"),
    ("//o.example/p", "http://o.example/p"), ("mailto:a@b", "mailto:a@b"), ("g//h", "{R}{D}/g/h"), (" f ", "{R}{D}/f"), ("http:i", "{R}{D}/i"), ("x?y=/../z", "{R}{D}/x?y=/../z"), ("https://o.example/a/../b", "https://o.example/a/../b"),
)


def _values(rows: list[tuple[int, str]]) -> str:
    return ", ".join(f"({n}, {lit(x)})" for n, x in rows)


ORACLE_SQL: dict[str, str] = {
    "clean_html_cases": f"SELECT page_id, n, x || chr(10) || page_id AS text FROM pages, (VALUES {_values([(n, x) for n, (_, x) in enumerate(CLEAN_CASES)])}) AS c(n, x)",
    "resolve_links": f"""SELECT page_id, n, replace(replace(x, '{{R}}', 'http://h' || page_id % 7 || '.example'), '{{D}}', '/a/d' || page_id) AS link
FROM pages, (VALUES {_values([(n, x) for n, (_, x) in enumerate(LINK_CASES)])}) AS c(n, x)""",
    "hybrid_retrieve": boosted(tfidf(abstract(deidentify("text")))),
    "tfidf_sparse_topk": tfidf(),
    "tfidf_bigram_topk": tfidf(ngram_max=2, min_df=2),
    "tfidf_vocabulary": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)
SELECT term, count(*)::BIGINT AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM g GROUP BY term""",
    "dense_topk": dense(8),
    "minmax_normalize": minmax(dense(8)),
    "weighted_fusion": fused(tfidf()),
    "guideline_boost": boosted(tfidf()),
    "theta_gate": f"SELECT item_id AS query_id, coalesce(best, 0.0) AS top_score, coalesce(best, 0.0) <= 0.75 AS external FROM benchmark LEFT JOIN (SELECT query_id, max(score) AS best FROM ({boosted(tfidf())}) GROUP BY 1) h ON h.query_id = item_id",
    "tiered_search_dedupe": f"""WITH h AS (SELECT query_id, seg_id, score, CASE WHEN doc_id % 4 = 0 THEN 'realtime' ELSE 'historical' END AS tier, substring(text, 1, 200) AS prefix FROM ({dense(24)}) JOIN documents ON doc_id = seg_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, seg_id) AS tr FROM h) WHERE tr <= 12),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, prefix ORDER BY tier, tr) AS c FROM t) WHERE c = 1)
SELECT query_id, tier, seg_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, tr) AS rank FROM o) WHERE rank <= 6""",
    "deidentify_documents": f"SELECT doc_id, sha1({deidentify('text')}) AS masked_sha1, length({deidentify('text')})::BIGINT AS n_chars FROM documents",
    "deidentify_synthetic": f"""SELECT o_orderkey, {deidentify("('call ' || lpad(o_orderkey::VARCHAR, 11, '1') || ' id ' || lpad(o_orderkey::VARCHAR, 17, '2') || 'X on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at 9:30, mail u' || o_orderkey || '@mail.example.org or ' || lpad(o_orderkey::VARCHAR, 7, '3') || ' times ' || o_orderkey)")} AS masked FROM orders""",
    "abstract_query": f"SELECT conv_id, turn, {abstract('text')} AS abstract FROM conversations WHERE role = 'user'",
    "trim_words": rf"SELECT doc_id, CASE WHEN len(w) <= 25 THEN {strip('text')} ELSE array_to_string(list_slice(w, 1, 25), ' ') END AS trimmed FROM (SELECT doc_id, text, string_split_regex({strip('text')}, '\s+') AS w FROM documents)",
    "build_prompt": f"""SELECT item_id AS query_id, {strip(f"{lit(PROMPT_HEAD.format(max_words=CONFIG.max_words, context=CONFIG.context))} || coalesce(l, '') || {lit(PROMPT_QUESTION)} || {deidentify('text')}")} AS prompt
FROM benchmark LEFT JOIN (SELECT query_id, string_agg({LOCAL}, chr(10) ORDER BY rank) AS l FROM ({boosted(tfidf())}) JOIN documents ON doc_id = seg_id GROUP BY 1) h ON h.query_id = item_id""",
    "classify_unsuitable": f"SELECT o_orderkey, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(t), {lit(p)}) THEN {lit(n)} END' for n, p in UNSUITABLE)}], lambda x: x IS NOT NULL), ',') AS labels FROM (SELECT o_orderkey, {POLICY} AS t FROM orders)",
    "is_academic": f"SELECT doc_id, {IS_ACADEMIC} AS is_academic FROM {MARKED}",
    "is_book": f"SELECT doc_id, {IS_BOOK_WHOLE} AS is_book, CASE WHEN {IS_BOOK} THEN 'book' WHEN {IS_ACADEMIC} THEN 'academic' ELSE 'generic' END AS route FROM {MARKED}",
    "book_type": rf"SELECT doc_id, CASE {' '.join(f'WHEN regexp_matches(substring(t, 1, 5000), {lit(p)}) THEN {lit(n)}' for n, p in BOOK_TYPES)} WHEN regexp_matches(substring(t, 1, 5000), {lit(NOVEL_WORDS)}) AND len(list_filter(string_split_regex(substring(t, 1, 5000), '\s+'), lambda w: w <> '')) > 200 THEN 'novel' WHEN regexp_matches(substring(t, 1, 5000), {lit(DRUG_WORDS)}) THEN 'drug' ELSE 'unknown' END AS book_type FROM {MARKED}",
    "normalize_text": f"SELECT doc_id, sha1({normalize(NORMAL_RAW)}) AS normal_sha1, length({normalize(NORMAL_RAW)})::BIGINT AS n_chars FROM documents",
    "title_doi": rf"""WITH p AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Clinical Guideline for part ' || doc_id || chr(10) || 'doi 10.1234/AbC-' || doc_id || ' x' ELSE '' END AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 20) AS ls FROM p)
SELECT doc_id, coalesce(list_filter(ls, lambda x: contains(lower(x), 'guideline'))[1],
 nullif(list_reduce(list_append(list_filter(ls, lambda x: NOT contains(lower(x), 'et al')), ''), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END), '')) AS title,
 nullif(regexp_extract(t, '(?i)10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+', 0), '') AS doi FROM l""",
    "qc_ratio": r"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '\s', '', 'g')) / length(text) END, 6) AS ratio FROM documents",
    "find_headings": headings(),
    "build_sections": f"""WITH h AS ({headings()}), p AS (SELECT * FROM {PAGES}),
m AS (SELECT p.*, h.section_id, h.section_title, count(h.page_no) OVER (PARTITION BY p.file_name ORDER BY p.page_no) AS num, count(h.page_no) OVER (PARTITION BY p.file_name) AS heads FROM p LEFT JOIN h ON h.file_name = p.file_name AND h.page_no = p.page_no)
SELECT file_name, coalesce(max(section_id), '0') AS section_id, coalesce(max(section_title), 'document') AS section_title, min(page_no) AS page_start, max(page_no) AS page_end,
 length(string_agg(text, chr(10) || chr(10) ORDER BY page_no))::BIGINT AS n_chars, sha1(string_agg(text, chr(10) || chr(10) ORDER BY page_no)) AS text_sha1 FROM m WHERE num > 0 OR heads = 0 GROUP BY file_name, num""",
    "window_chunks": f"SELECT doc_id, i::INT AS chunk_index, sha1(c) AS chunk_sha1 FROM (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, {WINDOWS} AS w FROM documents))",
    "segment_ids": f"SELECT doc_id, i::INT AS j, sha1(source || '|0|' || i || '|' || substring(c, 1, 80)) AS seg_id FROM (SELECT doc_id, source, unnest(w) AS c, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, source, {WINDOWS} AS w FROM documents))",
    "pack_paragraphs": chunked(paragraphs()),
    "pack_sentences": chunked(pack(sentences("t"), 500, "''", 0)),
    "length_chunks": hashed(length_rows(WHOLE)),
    "sentence_chunks": hashed(sentence_rows(WHOLE)),
    "main_content_chunks": main_parts(),
    "textbook_chunks": titled("textbook", TEXTBOOK, True),
    "novel_chunks": titled("novel", NOVEL, False),
    "manual_chunks": titled("manual", MANUAL, True),
    "reference_chunks": titled("reference", REFERENCE_BOOK, True),
    "pack_words": chunked(pack(r"list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')", 500, "' '", 2)),
    "pack_lines": chunked(lines_packed("t")),
    "pack_default": chunked(default_packed()),
    "split_references": chunked(references(), r"(SELECT doc_id, regexp_replace(text, '\. ', '.' || chr(10) || '[7] ', 'g') AS t FROM documents)"),
    "split_abstract": chunked(
        f"CASE WHEN contains(t, 'Abstract:') THEN list_filter([{strip('substring(t, 1, instr(t, lit) - 1)'.replace('lit', lit('Abstract:')))}, 'Abstract:' || {strip('substring(t, instr(t, lit) + 9)'.replace('lit', lit('Abstract:')))}], lambda x: x <> '') ELSE [substring(t, 1, 500)] END",
        r"(SELECT doc_id, regexp_replace(text, '^([A-Z][a-z]*) ', '\1 Abstract: ', 'g') AS t FROM documents)",
    ),
    "split_drug": chunked(pack(kept(f"string_split(regexp_replace(t, '【({DRUG_LABELS})】', chr(1) || '\\1' || chr(1), 'g'), chr(1))"), 500, "chr(10)", 2), "(SELECT doc_id, replace(text, '. ', '【性状】') AS t FROM documents)"),
    "academic_lines": chunked(academic(), r"(SELECT doc_id, regexp_replace(text, '\. ', '.' || chr(10) || 'RESULTS' || chr(10), 'g') AS t FROM documents)"),
    "filter_small_chunks": rf"SELECT doc_id, i::INT AS chunk_index, {KEEP} AS kept, length(s) >= 20 AND len(string_split_regex(s, '\s+')) >= 3 AND regexp_matches(s, '[\p{{L}}\p{{N}}]') AS kept_simple FROM (SELECT doc_id, i, {strip('c')} AS s FROM (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, string_split_regex(text, '[.,]') AS w FROM documents)))",
    "drop_contained_neighbours": f"SELECT doc_id, len(k)::BIGINT AS n_kept, sha1(array_to_string(k, '|')) AS kept_sha1 FROM (SELECT doc_id, {CONTAINED} AS k FROM documents)",
    "clean_html": f"SELECT page_id, sha1({cleaned('html')}) AS text_sha1, length({cleaned('html')})::BIGINT AS n_chars FROM pages",
    "extract_links": LINKS,
    "token_estimate": "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents",
    "file_limits": """SELECT path, length, lower(string_split(path, '.')[-1]) IN ('pdf', 'txt') AND length > 0 AND length <= 20971520 AS indexable, length <= 524288000 AS valid, length > 104857600 AS large,
 (length // 1000)::BIGINT AS est_chunks, (length // 1000) / 10 AS est_seconds FROM (SELECT 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' ELSE '.doc' END AS path, n_chars * (doc_id % 2000) * 10 AS length FROM documents)""",
    "source_dispatch": f"""SELECT doc_id, CASE WHEN s LIKE 'http://%' OR s LIKE 'https://%' THEN 'url' WHEN s LIKE '%.txt' AND len(list_filter(list_slice(string_split(h, chr(10)), 1, 5), lambda x: starts_with({strip('x')}, 'http'))) > 0 THEN 'url_list' ELSE 'file' END AS source_type
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://a.example/' || doc_id WHEN 3 THEN 'list.pdf' ELSE 'list.txt' END AS s, CASE WHEN doc_id % 4 = 1 THEN 'one' || chr(10) || ' http://b.example' || chr(10) || text ELSE text END AS h FROM documents)""",
    "url_list": "SELECT url FROM pages",
    "chunk_scale": rf"""WITH c AS (SELECT coalesce(sum(length(text)), 0) AS n FROM documents WHERE {strip('text')} <> ''), e AS (SELECT greatest(1, n // 500)::BIGINT AS est FROM c), s AS (SELECT est, least(3.0::DOUBLE, est / 100.0::DOUBLE) AS scale FROM e),
z AS (SELECT est, scale, CASE WHEN est > 100 THEN floor(500 * scale) ELSE 500 END AS size FROM s)
SELECT est AS est_chunks, size::BIGINT AS chunk_size, CASE WHEN est > 100 THEN least(floor(50 / scale), floor(size / 3)) ELSE 50 END::BIGINT AS chunk_overlap FROM z""",
    "review_latest": f"SELECT * FROM {reviewed(REVIEWS)}",
    "review_pending": f"""SELECT task_id::BIGINT AS task_id, request_id, seq FROM (SELECT *, row_number() OVER (ORDER BY seq) AS task_id FROM {reviewed(REVIEWS)}) WHERE status = 'PENDING' OR request_id % 2 = 0 ORDER BY seq LIMIT 20""",
    "deliver_status": f"""SELECT u.request_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'PENDING' THEN 'pending_review' ELSE 'delivered' END AS result,
 CASE WHEN status <> 'PENDING' THEN coalesce(nullif(final_text, ''), nullif(draft, ''), '') END AS text FROM (SELECT DISTINCT user_id AS request_id FROM events UNION ALL SELECT -5) u LEFT JOIN {reviewed(REVIEWS)} r ON r.request_id = u.request_id""",
    "exposure_latest": """WITH r AS (SELECT user_id, max(event_id) AS s FROM events WHERE event_type = 'signup' GROUP BY 1),
e AS (SELECT e.*, s FROM events e JOIN r USING (user_id))
SELECT user_id AS request_id, (count(*) FILTER (event_type = 'purchase' AND event_id > s) > 0)::INT AS delivered, (count(*) FILTER (event_type = 'view' AND event_id > s) > 0)::INT AS viewed,
 strftime(arg_max(ts, event_id) FILTER (event_type = 'purchase' AND event_id > s), '%Y-%m-%d %H:%M:%S') AS delivered_at, strftime(arg_max(ts, event_id) FILTER (event_type = 'view' AND event_id > s), '%Y-%m-%d %H:%M:%S') AS viewed_at FROM e GROUP BY user_id""",
    "audit_funnel": "SELECT event_type AS event, count(*)::BIGINT AS n_events, count(DISTINCT user_id)::BIGINT AS n_requests FROM events GROUP BY 1",
    "audit_session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS num FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, num""",
    "session_events": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, event_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS num FROM g)
SELECT user_id, epoch_us(min(ts) OVER (PARTITION BY user_id, num)) AS session_us, event_id FROM s""",
    "section_pages": f"""WITH h AS ({headings()}), p AS (SELECT * FROM {PAGES}),
m AS (SELECT p.*, h.section_id, count(h.page_no) OVER (PARTITION BY p.file_name ORDER BY p.page_no) AS num, count(h.page_no) OVER (PARTITION BY p.file_name) AS heads FROM p LEFT JOIN h ON h.file_name = p.file_name AND h.page_no = p.page_no)
SELECT file_name, coalesce(max(section_id), '0') AS section_id, min(page_no) AS page_start, count(*)::BIGINT AS n_pages, max(page_no)::BIGINT AS last_page FROM m WHERE num > 0 OR heads = 0 GROUP BY file_name, num""",
    "crawl_source": f"""WITH site AS (SELECT {SITE_URL} AS url, {SITE_HTML} AS html FROM pages)
SELECT l.url AS seed, l.ord, l.link AS url, length(s.html)::BIGINT AS n_chars FROM ({LINKS.replace('FROM pages', 'FROM site')}) l LEFT JOIN site s ON s.url = l.link""",
    "crawl_progress": f"""SELECT 'pages' AS stage, count(*)::BIGINT AS n_rows, sum(strlen(url) + strlen(html))::BIGINT AS n_bytes FROM pages
UNION ALL SELECT 'links', count(*)::BIGINT, sum(strlen(url) + strlen(link))::BIGINT FROM ({LINKS})""",
    "index_grown_topk": tfidf(),
    "dense_cells_topk": dense(8),
    "ttl_alive": "SELECT event_id FROM events WHERE event_id % 3 <> 1",
    "kb_status": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'realtime' ELSE 'historical' END AS tier, count(DISTINCT source)::BIGINT AS n_sources, count(*)::BIGINT AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1",
    "kb_merge": "SELECT 'historical' AS tier, true AS exists, count(DISTINCT source)::BIGINT AS n_sources, count(*)::BIGINT AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM documents UNION ALL SELECT 'realtime', true, 0, 0, 0",
    "segment_files": "SELECT doc_id::VARCHAR AS seg_id, source, CASE WHEN doc_id % 5 = 0 THEN 'guideline' ELSE 'education' END AS doc_type, (doc_id % 10 + 2015)::INT AS pub_year, sha1(text) AS text_sha1 FROM documents",
    "demo_segments": "SELECT doc_id::VARCHAR AS seg_id, source, CASE WHEN doc_id % 5 = 0 THEN 'guideline' ELSE 'education' END AS doc_type, (doc_id % 10 + 2015)::INT AS pub_year, 'general' AS category, length(text)::BIGINT AS n_chars FROM documents UNION ALL SELECT * FROM (VALUES ('guideline_1', 'guideline_demo', 'guideline', 2023, 'postop_care', 139::BIGINT), ('edu_1', 'education_demo', 'education', 2022, 'warnings', 89)) t(seg_id, source, doc_type, pub_year, category, n_chars)",
    "join_documents": f"SELECT file_name, arg_min(page_no, page_no)::VARCHAR AS first_page, length(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (page_no % 10 <> 3), ''))::BIGINT AS n_chars, sha1(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (page_no % 10 <> 3), '')) AS text_sha1 FROM {PAGES} GROUP BY 1",
    "drop_blank": f"SELECT doc_id FROM documents WHERE doc_id % 7 <> 2 AND {strip('text')} <> ''",
    "chunk_metadata": f"""SELECT doc_id, (i - 1)::INT AS chunk_index, '{{"lang":"' || lang || '","chunk_index":"' || (i - 1) || '","total_chunks":"' || n || '"}}' AS metadata FROM (SELECT doc_id, lang, len(w) AS n, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, lang, {WINDOWS} AS w FROM documents))""",
    "external_evidence": f"""SELECT item_id AS query_id, i::INT AS ord, sha1(repeat(i::VARCHAR, 200)) AS title_sha1, 500::BIGINT AS url_chars, sha1(substring(repeat(a || ' ', 200), 1, 4000)) AS text_sha1, '2024-01-01 00:10:00' AS expires_at
FROM (SELECT item_id, {abstract('text')} AS a FROM benchmark), range(3) r(i)""",
    "chunk_statistics": f"SELECT source, count(*)::BIGINT AS n_chunks, round(avg(length(c)), 6) AS mean_chars, max(length(c))::BIGINT AS max_chars FROM (SELECT source, unnest({WINDOWS}) AS c FROM documents) GROUP BY 1",
    "quality_sample": rf"""WITH r AS (SELECT file_name, page_no, CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '\s', '', 'g')) / length(text) END AS ratio, row_number() OVER (PARTITION BY file_name ORDER BY md5(page_no::VARCHAR), page_no) AS k FROM {PAGES})
SELECT file_name, count(*)::BIGINT AS sample_n, round(avg(ratio), 6) AS nonempty_ratio_mean, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pages FROM r WHERE k <= 6 GROUP BY 1 UNION ALL SELECT 'nothing.pdf', 0, 0.0, ''""",
    "book_records": f"SELECT doc_id, (i - 1)::INT AS chunk_index, n::INT AS total_chunks, length(c)::INT AS chunk_size, sha1({strip('c')}) AS chunk_sha1 FROM (SELECT doc_id, len(cs) AS n, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, {titled_list('textbook', TEXTBOOK, True)} AS cs FROM {headed(TITLES['textbook'], 2)})) WHERE {strip('c')} <> ''",
    "indexed_sparse_topk": tfidf(),
    "indexed_retrieve": boosted(tfidf()),
    "index_info": r"""SELECT true AS exists, (SELECT count(*) FROM documents) AS n_segments, (SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS t FROM documents)) AS n_terms, (SELECT count(*) FROM embeddings) AS n_vectors, true AS has_bytes""",
    "load_documents": f"""WITH p AS (SELECT page_id, {SITE_URL} AS url, {SITE_HTML} AS html FROM pages),
s AS (SELECT page_id, url FROM p WHERE page_id % 5 = 0),
w AS (SELECT url AS source, 1 AS page_no, page_id FROM s UNION ALL SELECT url, 2, page_id + 7 FROM s UNION ALL SELECT url, 3, page_id + 14 FROM s UNION ALL SELECT 'http://h1.example/p1', 1, 1),
d AS (SELECT source, page_no, {cleaned('html')} AS t FROM w JOIN p USING (page_id)
 UNION ALL SELECT 'd' || doc_id || '.txt', 1, text FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT 'd' || doc_id || '.pdf', generate_subscripts(ps, 1), unnest(ps) FROM (SELECT doc_id, string_split(replace(text, '. ', chr(12)), chr(12)) AS ps FROM documents WHERE doc_id % 3 = 1))
SELECT source, page_no::INT AS page_no, length(t)::BIGINT AS n_chars, sha1(t) AS text_sha1 FROM d""",
    "failed_sources": "SELECT 'd' || doc_id || '.doc' AS source, 'unsupported file type: doc' AS error FROM documents WHERE doc_id % 3 = 2 UNION ALL SELECT 'http://none.example/x', 'not found' UNION ALL SELECT 'gone.txt', 'not found'",
    "transcripts": f"SELECT conv_id::VARCHAR AS source, length(string_agg(text, chr(10) ORDER BY turn, text))::BIGINT AS n_chars, sha1(string_agg(text, chr(10) ORDER BY turn, text)) AS text_sha1 FROM conversations WHERE {strip('text')} <> '' GROUP BY 1",
    "review_by_request": f"SELECT request_id, seq, status, final_text FROM {reviewed(REVIEWS)} WHERE request_id % 3 = 0 AND request_id < 120",
    "ask_audit": f"""WITH h AS ({boosted(tfidf())}), g AS (SELECT query_id, count(*) AS n, max(score) AS top FROM h GROUP BY 1),
r AS (SELECT item_id AS request_id, text, coalesce(n, 0) AS n, coalesce(top, 0.0::DOUBLE) AS top, coalesce(top, 0.0::DOUBLE) <= 0.75 AS ext, row_number() OVER (ORDER BY item_id % 2, item_id) AS task, {abstract(deidentify('text'))} AS abstract,
 array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(text), {lit(p)}) THEN {lit(n)} END' for n, p in UNSUITABLE)}], lambda x: x IS NOT NULL), ',') AS labels FROM benchmark LEFT JOIN g ON query_id = item_id)
SELECT request_id, 0 AS ord, 'query_received' AS event, '{{"user_id":"u' || request_id % 3 || '","len":' || length(text) || '}}' AS payload FROM r
UNION ALL SELECT request_id, 1, 'query_deidentified', '{{"abstract":"' || abstract || '"}}' FROM r
UNION ALL SELECT request_id, 2, 'local_retrieval_done', '{{"hits":' || n || ',"top_score":' || top || ',"theta":0.75}}' FROM r
UNION ALL SELECT request_id, 3, CASE WHEN ext THEN 'external_retrieval_triggered' ELSE 'external_retrieval_skipped' END, CASE WHEN ext THEN '{{"used":0}}' ELSE '{{}}' END FROM r
UNION ALL SELECT request_id, 4, 'draft_generated', '{{"chars":22}}' FROM r
UNION ALL SELECT request_id, 5, 'queued_for_human_review', '{{"task_id":' || task || ',"unsuitable":"' || labels || '"}}' FROM r""",
    "ask_agreement": "SELECT item_id AS request_id, row_number() OVER (ORDER BY item_id % 2, item_id) AS task_id, 'PENDING' AS status, true AS same FROM benchmark",
    "deliver_events": f"""WITH d AS (SELECT request_id, coalesce(nullif(final_text, ''), nullif(draft, ''), '') AS text FROM {reviewed(REVIEWS)} WHERE status <> 'PENDING')
SELECT request_id, 'deliver' AS event, NULL AS payload FROM d UNION ALL SELECT request_id, 'view', NULL FROM d UNION ALL SELECT request_id, 'delivered_to_patient', '{{"chars":' || length(text) || '}}' FROM d""",
    "evidence_get": """WITH s AS (SELECT epoch_us(ts) // 1000 AS evidence_id, arg_max(event_id, event_id) AS seq, arg_max(ts, event_id) AS ts FROM events GROUP BY 1)
SELECT e.event_id AS ask, s.evidence_id, 'text ' || s.seq AS text FROM events e JOIN s ON s.evidence_id = epoch_us(e.ts) // 1000
WHERE e.ts + CASE e.event_id % 3 WHEN 0 THEN INTERVAL 600 SECOND WHEN 1 THEN INTERVAL 600000001 MICROSECOND ELSE INTERVAL 5 SECOND END <= s.ts + INTERVAL 600 SECOND""",
}
