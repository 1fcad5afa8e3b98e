"""DuckDB SQL for the registered queries, over the same parquet tables."""

from __future__ import annotations

from mailspark.config import QUOTE_PATTERNS, SEPARATORS
from mailspark.functions.text import WHITESPACE
from mailspark.sources.models import MODELS

NL = "CHR(10)"
SPACES = "'" + WHITESPACE + "'"
CHUNK = 1792
TOP_SENTENCES = 5
# 1000 tokens of 3.5 characters, less the prompt's 857 and the 2 that join it to the text.
HIERARCHY_BUDGET = 2641

EMAILS = f"""
b AS (
  SELECT conv_id, turn, role,
    CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN ''
         ELSE CONCAT(text,
           CASE WHEN conv_id % 5 = 0 THEN CONCAT({NL}, {NL}, 'see https://example.org/p/', conv_id, '?t=', turn, ' and www.example.com/x') ELSE '' END,
           CASE WHEN turn > 0 AND turn % 3 = 0 THEN CONCAT({NL}, {NL}, 'On Mon, someone wrote:', {NL}, 'zzzz') ELSE '' END)
    END AS base
  FROM conversations),
c AS (
  SELECT *, LAG(base) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_base,
            MAX(turn) OVER (PARTITION BY conv_id) AS last_turn
  FROM b),
emails AS (
  SELECT CONCAT('m', conv_id, '-', turn) AS id, CONCAT('m', conv_id, '-0') AS thread_id,
    CASE WHEN turn > 0 THEN CONCAT('m', conv_id, '-', turn - 1) END AS in_reply_to,
    list_transform(range(turn), lambda t: CONCAT('m', conv_id, '-', t)) AS refs,
    CONCAT(CASE WHEN turn > 0 THEN 'Re: ' ELSE ' ' END, 'topic ', conv_id) AS subject,
    CONCAT(role, conv_id % 7, '@example.com') AS sender,
    TIMESTAMP '2024-01-01 08:00:00' + INTERVAL '1' DAY * (conv_id % 28) + INTERVAL '1' HOUR * turn AS date,
    CASE WHEN turn % 3 = 1
         THEN CONCAT(base, {NL}, {NL}, 'On Mon, someone wrote:', {NL}, prev_base)
         ELSE base END AS body,
    CASE conv_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN turn < last_turn ELSE FALSE END AS is_embedded
  FROM c)"""

ATTACHMENTS = """
attachments AS (
  SELECT CONCAT('a', doc_id) AS id,
    CONCAT('m', CAST(FLOOR(doc_id / 4) AS BIGINT) % (SELECT MAX(conv_id) + 1 FROM conversations), '-0') AS email_id,
    CONCAT('doc', doc_id, CASE WHEN doc_id % 8 = 0 THEN '.TXT' ELSE '.csv' END) AS filename,
    CASE WHEN doc_id % 8 = 0 THEN 'text/plain' ELSE 'text/csv' END AS mime_type,
    CASE WHEN doc_id % 8 = 0 THEN '.txt' ELSE '.csv' END AS extension,
    CAST(n_chars AS INT) AS size,
    CASE WHEN lang <> 'es' THEN text END AS text_content
  FROM documents)"""

LINKS = r"https?://\S+|www\.\S+|ftp://\S+"


def strip(text: str) -> str:
    return f"trim({text}, {SPACES})"


def _split_case(body: str) -> str:
    """``[before, after]`` around the first pattern in list order, else NULL."""
    cases = []
    for pattern in QUOTE_PATTERNS:
        found = f"regexp_extract({body}, '(?i){pattern}')"
        at = f"strpos({body}, {found})"
        cases.append(
            f"WHEN regexp_matches({body}, '(?i){pattern}') THEN "
            f"[{body}[:{at} - 1], {body}[{at} + length({found}):]]"
        )
    return "CASE " + "\n ".join(cases) + " END"


QUOTES = f"quotes AS (SELECT id, thread_id, body, {_split_case('body')} AS q FROM emails)"

OWN_TEXT = f"""
{QUOTES},
pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY date, id) AS n FROM emails),
own AS (
  SELECT p.*, {strip('''CASE WHEN p.n > 1 AND r.id IS NOT NULL AND trim(q.q[2], ''' + SPACES + ''') = trim(r.body, ''' + SPACES + ''')
    THEN q.q[1] ELSE p.body END''')} AS text
  FROM pos p LEFT JOIN quotes q USING (id)
  LEFT JOIN emails r ON r.thread_id = p.thread_id AND r.id = p.in_reply_to)"""

DOCS = f"""
{OWN_TEXT},
blocks AS (
  SELECT email_id, string_agg(CONCAT({NL}, {NL}, '--- Begin Attachment: ', filename, ' (', extension, ') ---', {NL},
    {strip('text_content')}, {NL}, '--- End Attachment ---'), '' ORDER BY filename, id) AS block
  FROM attachments WHERE text_content <> '' GROUP BY email_id),
docs AS (
  SELECT thread_id, regexp_replace(CONCAT('===== Begin Email Thread =====', {NL}, {NL}, 'Subject: ', {strip('MIN(root_subject)')}, {NL}, {NL},
    string_agg(CONCAT('--- Email ', n, ' ---', {NL}, 'Date: ', CAST(date AS VARCHAR), {NL}, {NL}, text, COALESCE(block, ''), {NL}, '--- End Email ---'),
      CONCAT({NL}, {NL}) ORDER BY n) FILTER (WHERE text <> ''),
    {NL}, {NL}, '===== End Email Thread ====='), '{LINKS}', '', 'g') AS text
  FROM (SELECT *, FIRST_VALUE(subject) OVER (PARTITION BY thread_id ORDER BY n) AS root_subject FROM own)
  LEFT JOIN blocks ON email_id = id GROUP BY thread_id HAVING bool_or(text <> ''))"""


def with_mail(*parts: str) -> str:
    return "WITH " + ",".join([EMAILS, ATTACHMENTS, *parts]) + "\n"


def chunk_ctes(source: str, key: str, size: int = CHUNK, name: str = "chunked", text: str = "text") -> str:
    """CTEs that end in ``<name>(key, pieces)``: the recursive splitting, level
    by level, with a fold that packs pieces up to the size."""
    steps = [f"{name}_0 AS (SELECT {key}, [{text}] AS p FROM {source})"]
    for level, separator in enumerate(SEPARATORS, 1):
        if separator:
            literal = "'" + separator.replace("\n", "' || CHR(10) || '") + "'"
            pieces = (
                f"list_filter(list_transform(string_split(x, {literal}), "
                f"lambda s, i: CASE WHEN i > 1 THEN {literal} || s ELSE s END), lambda s: s <> '')"
            )
            packed = (
                f"list_reduce(list_transform({pieces}, lambda s: [s]), lambda acc, y: "
                f"CASE WHEN length(acc[-1]) + length(y[1]) <= {size} "
                f"THEN list_append(acc[:-2], acc[-1] || y[1]) ELSE list_append(acc, y[1]) END)"
            )
        else:
            packed = f"list_transform(range((length(x) + {size - 1}) // {size}), lambda k: substr(x, k * {size} + 1, {size}))"
        steps.append(
            f"{name}_{level} AS (SELECT {key}, flatten(list_transform(p, lambda x: "
            f"CASE WHEN length(x) <= {size} THEN [x] ELSE {packed} END)) AS p FROM {name}_{level - 1})"
        )
    last = f"{name}_{len(SEPARATORS)}"
    steps.append(
        f"{name} AS (SELECT {key}, list_filter(list_transform(p, lambda x: {strip('x')}), lambda x: x <> '') AS pieces FROM {last})"
    )
    return ",\n".join(steps)


def chunk_rows(key: str, name: str = "chunked") -> str:
    return (
        f"SELECT {key}, CAST(i AS BIGINT) AS chunk_no, pieces[i + 1] AS text "
        f"FROM (SELECT *, unnest(range(len(pieces))) AS i FROM {name})"
    )


def summary_ctes(source: str, key: str = "thread_id", top: int = TOP_SENTENCES, name: str = "summaries", weight: str = "") -> str:
    """CTEs that end in ``<name>(key, summary)``; ``weight`` names a table of words and
    their weights."""
    n = f"COUNT(*) OVER (PARTITION BY {key}, word)"
    joined = ""
    if weight:
        n, joined = f"{n} * weight", f"LEFT JOIN {weight} USING (word)"
    return f"""
{name}_lists AS (
  SELECT {key}, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) +', '\\1' || {NL}, 'g'), {NL}),
    lambda s: {strip('s')}), lambda s: s <> '' AND NOT regexp_matches(s, '^(---|=====|Date: )')) AS ss FROM {source}),
{name}_rows AS (SELECT {key}, i AS place, ss[i + 1] AS sentence FROM (SELECT *, unnest(range(len(ss))) AS i FROM {name}_lists)),
{name}_words AS (
  SELECT {key}, place, sentence, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS word
  FROM (SELECT *, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {name}_rows)),
{name}_counted AS (
  SELECT *, CASE WHEN word IS NULL THEN 0 ELSE {n} END AS n FROM {name}_words {joined}),
{name}_scored AS (
  SELECT {key}, place, ANY_VALUE(sentence) AS sentence,
    CAST(SUM(n) AS DOUBLE) / GREATEST(COUNT(*), 8) AS score FROM {name}_counted GROUP BY {key}, place),
{name} AS (
  SELECT {key}, string_agg(sentence, {NL} ORDER BY place) AS summary FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY score DESC, place) AS rank FROM {name}_scored)
  WHERE rank <= {top} GROUP BY {key})"""


# Words of all threads with ln((1 + N) / (1 + threads that hold it)) in whole thousandths.
WEIGHTS = """
held AS (SELECT DISTINCT thread_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM docs),
weights AS (
  SELECT word, CAST(FLOOR(ln((1.0 + (SELECT COUNT(*) FROM docs)) / (1 + COUNT(*))) * 1000) AS BIGINT) AS weight
  FROM held GROUP BY word)"""


def hierarchical_sql(budget: int, top: int, rounds: int) -> str:
    """Partial summaries joined and summarized again, round after round, each within
    the budget. A thread is done in the round that gives it one group."""
    steps, done, source = [DOCS], [], "docs"
    for r in range(1, rounds + 1):
        steps += [
            chunk_ctes(source, "thread_id", budget, f"cut{r}"),
            f"groups{r} AS ({chunk_rows('thread_id', f'cut{r}')})",
            summary_ctes(f"groups{r}", "thread_id, chunk_no", top, f"parts{r}"),
            f"joined{r} AS (SELECT thread_id, COUNT(*) AS n, string_agg(summary, {NL} || {NL} ORDER BY chunk_no) AS text FROM parts{r} GROUP BY thread_id)",
            f"next{r} AS (SELECT thread_id, text FROM joined{r} WHERE n > 1)",
        ]
        done.append(f"SELECT thread_id, text AS summary FROM joined{r} WHERE n = 1")
        source = f"next{r}"
    done.append(f"SELECT thread_id, text AS summary FROM {source}")
    return with_mail(*steps) + " UNION ALL ".join(done)


MODEL_ROWS = ", ".join(f"('{name}', '{kind}', {dim}, {tokens}, {i})" for i, (name, kind, dim, tokens) in enumerate(MODELS))

# Which extension a file name built from doc_id has, and what it should give.
FILE_NAMES = (
    ("'report' || doc_id || '.PDF'", "'.pdf'"),
    ("'a' || doc_id || '.tar.GZ'", "'.gz'"),
    ("'.profile' || doc_id", "''"),
    ("'dir.d/name' || doc_id", "''"),
    ("'x' || doc_id || '.'", "'.'"),
    ("'..y' || doc_id || '.Txt'", "'.txt'"),
)


def _cases(column: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(values))
    return f"CASE {column} {whens} END"


def _oracles() -> dict[str, str]:
    mail = with_mail()
    docs = with_mail(DOCS)
    sql = {}

    # threads
    sql["email_position"] = mail + "SELECT id, thread_id, CAST(ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY date, id) AS BIGINT) AS position FROM emails"
    sql["pending_threads"] = mail + "SELECT DISTINCT thread_id FROM emails WHERE is_embedded = FALSE"
    pending = "(SELECT thread_id FROM emails WHERE is_embedded = FALSE)"
    sql["thread_emails"] = mail + f"""SELECT id, thread_id, CAST(ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY date, id) AS BIGINT) AS position, body
      FROM emails WHERE thread_id IN {pending}"""
    sql["rebuild_scope"] = mail + f"SELECT id, thread_id, is_embedded FROM emails WHERE thread_id IN {pending}"
    sql["email_attachments"] = mail + """SELECT e.id, COUNT(a.id) AS attachments_count, CAST(COALESCE(SUM(a.size), 0) AS BIGINT) AS attachments_size
      FROM emails e LEFT JOIN attachments a ON a.email_id = e.id GROUP BY e.id"""
    sql["reply_parent"] = mail + """SELECT e.id, p.id AS parent_id, CAST(length(p.body) AS BIGINT) AS parent_chars
      FROM emails e LEFT JOIN emails p ON p.thread_id = e.thread_id AND p.id = e.in_reply_to"""
    sql["quote_split"] = with_mail(QUOTES) + "SELECT id, q[1] AS head, q[2] AS tail FROM quotes"
    sql["quote_strip"] = with_mail(OWN_TEXT) + "SELECT id, text FROM own"
    sql["quote_diff"] = """SELECT doc_id, 2.0::DOUBLE * ((length(text) * (55 + doc_id % 9 * 5) + 99) // 100) / (2 * (length(text) + 3)) >= 0.8 AS similar FROM documents"""
    sql["thread_document"] = docs + "SELECT thread_id, CAST(0 AS BIGINT) AS segment, text FROM docs"
    sql["thread_document_segmented"] = docs + "SELECT thread_id, text FROM docs"
    metadata = """
meta AS (
  SELECT e.thread_id, arg_min(e.subject, (e.date, e.id)) AS subject, arg_min(e.sender, (e.date, e.id)) AS sender,
    COUNT(*) AS email_count, CAST(SUM(COALESCE(a.n, 0)) AS BIGINT) AS attachments_count,
    CAST(MIN(e.date) AS VARCHAR) AS first_email_date, CAST(MAX(e.date) AS VARCHAR) AS last_email_date
  FROM emails e LEFT JOIN (SELECT email_id, COUNT(*) AS n FROM attachments GROUP BY email_id) a ON a.email_id = e.id
  GROUP BY e.thread_id)"""
    sql["thread_metadata"] = with_mail(metadata) + "SELECT * FROM meta"
    sql["latest_email"] = mail + "SELECT id, date, sender FROM emails ORDER BY date DESC, id DESC LIMIT 1"

    # ingest
    sql["first_wins_dedup"] = mail + """SELECT id, subject, source FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY (length(body) + source) % 2) AS r FROM (
        SELECT id, subject, body, 0 AS source FROM emails UNION ALL SELECT id, 'copy ' || subject, body, 1 FROM emails)) WHERE r = 1"""
    sql["emails_insert_new"] = mail + "SELECT id, thread_id, subject FROM emails WHERE id NOT IN (SELECT id FROM emails WHERE is_embedded)"
    sql["attachments_insert"] = mail + """SELECT sha256(a.email_id || '/' || a.filename) AS id, a.email_id, a.filename, a.size
      FROM attachments a JOIN emails e ON e.id = a.email_id WHERE NOT e.is_embedded"""
    sql["attachments_dedup"] = """SELECT email_id, filename, part_no, size FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY email_id, filename ORDER BY part_no DESC) AS r FROM (
        SELECT 'm' || (doc_id % 40) AS email_id, lang || '.txt' AS filename, doc_id AS part_no, n_chars AS size FROM documents)) WHERE r = 1"""
    sql["mark_embedded"] = mail + "SELECT id, is_embedded OR length(body) % 2 = 0 AS is_embedded FROM emails"
    sql["references_split"] = mail + "SELECT id, CAST(len(refs) AS INT) AS n, array_to_string(refs, '|') AS refs FROM emails"
    sql["thread_root"] = mail + "SELECT id, thread_id AS root FROM emails"
    sql["recipients"] = "SELECT conv_id, turn, CONCAT(role, conv_id, '@example.com|list-', turn, '@lists.example.org') AS recipients FROM conversations"
    sql["body_select"] = mail + f"SELECT id, {strip('body')} AS body FROM emails"
    sql["text_normalize"] = f"""SELECT page_id, {strip("regexp_replace(regexp_replace(regexp_replace(html, '[' || CHR(8204) || CHR(8205) || CHR(8206) || CHR(8207) || CHR(8234) || '-' || CHR(8238) || CHR(8288) || '-' || CHR(8303) || CHR(173) || CHR(160) || ']', ' ', 'g'), '[ ' || CHR(9) || ']+', ' ', 'g'), CHR(10) || '[' || " + SPACES + " || ']*' || CHR(10) || '+', CHR(10) || CHR(10), 'g')")} AS text FROM pages"""
    sql["remove_links"] = mail + f"SELECT id, regexp_replace(body, '{LINKS}', '', 'g') AS text FROM emails"
    sql["file_extension"] = f"SELECT doc_id, {_cases('doc_id % 6', [name for name, _ in FILE_NAMES])} AS filename, {_cases('doc_id % 6', [ext for _, ext in FILE_NAMES])} AS extension FROM documents"
    csv = """len(ls) >= 2 AND list_min(cs) > 0 AND list_min(cs) = list_max(cs)"""
    sql["mime_detect"] = f"""WITH l AS (
      SELECT doc_id, text, list_filter(string_split_regex(text, '\\r?\\n'), lambda s: s <> '')[1:10] AS ls FROM documents),
      d AS (SELECT *, list_transform(ls, lambda s: length(s) - length(replace(s, ',', ''))) AS cs FROM l)
      SELECT doc_id AS id, CASE doc_id % 5 WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'audio/ogg' WHEN 4 THEN 'application/zip'
        ELSE CASE WHEN regexp_matches(text, '^(Return-Path|Received|From|Message-ID|Delivered-To|MIME-Version|Date|Subject|To): ') THEN 'message/rfc822'
          WHEN {csv} THEN 'text/csv' ELSE 'text/plain' END END AS mime FROM d
      UNION ALL SELECT -1 - page_id, 'text/html' FROM pages"""
    sql["b64url_decode"] = "SELECT doc_id, text FROM documents"
    shown = r"regexp_replace(regexp_replace(regexp_replace(html, '<head>.*?</head>|<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'gs'), '<[^>]*>', '', 'g'), '&#?[a-zA-Z0-9]+;', '', 'g')"
    sql["html_pages"] = f"SELECT page_id, regexp_replace({shown}, '[^\\p{{L}}]', '', 'g') AS letters FROM pages"
    sql["parse_date"] = "SELECT event_id, CASE WHEN event_id % 8 <> 7 THEN date_trunc('second', ts) END AS date FROM events"
    sql["html_to_text"] = f"""SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) || {NL} || {NL} || '# Title' || {NL} || {NL} || '* one <' || {NL} || '* two & more' AS text FROM conversations"""
    sql["attachment_text"] = f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '{{' || {NL} || '  "k": ' || doc_id || ',' || {NL} || '  "l": [' || {NL} || '    1' || {NL} || '  ]' || {NL} || '}}'
      WHEN 2 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) WHEN 3 THEN 'From: a@x' || {NL} || 'To: b@x' || {NL} || 'Subject: s ' || doc_id || {NL} || {NL} || {strip('text')} ELSE '' END AS text FROM documents"""
    sql["attachment_archive"] = f"""SELECT doc_id, '===== in/a.TXT =====' || {NL} || COALESCE(text, '') || {NL} || {NL} || '===== c.json =====' || {NL} || doc_id AS text FROM documents"""
    sql["parse_mbox"] = mail + f"""SELECT id, thread_id, ltrim(subject) AS subject, in_reply_to, CAST(len(refs) AS INT) AS n_references, date, sender,
      {strip("regexp_replace(body, '(?m)^From ', '>From ', 'g')")} AS body FROM emails"""
    sql["store_insert"] = sql["parse_mbox"].replace("CAST(len(refs) AS INT) AS n_references, ", "")
    sql["mbox_scan"] = mail + "SELECT id AS message_id, COUNT(*) AS n FROM emails GROUP BY id"
    sql["mbox_first"] = mail + "SELECT id FROM emails ORDER BY id LIMIT (SELECT COUNT(*) // 2 FROM emails)"
    sql["parse_gmail"] = mail + f"SELECT id, thread_id, subject, in_reply_to, date, sender, 'second@example.com' AS recipients, {strip('body')} AS body FROM emails"
    sql["parse_mbox_multipart"] = mail + f"""SELECT id, 'Größe ' || id AS subject, sender, date,
      CASE WHEN CAST(regexp_extract(id, '-([0-9]+)$', 1) AS INT) % 2 = 1 THEN 'Answer ' || id ELSE {strip('body')} END AS body,
      'note.TXT' AS filename, '.txt' AS extension, 'text/plain' AS mime_type, CAST(length('file of ' || id) AS INT) AS size, 'file of ' || id AS text_content FROM emails"""
    sql["quarantine"] = mail + "SELECT id, CAST(regexp_extract(id, '^m([0-9]+)-', 1) AS BIGINT) % 7 = 0 AS rejected FROM emails"
    sql["incremental_poll"] = mail + """SELECT id AS resource_id, CAST(epoch_ms(date) AS BIGINT) AS internal_date FROM emails
      WHERE date > (SELECT max(date) FROM emails WHERE date <= (SELECT min(date) + INTERVAL '10' DAY FROM emails))"""
    sql["header_map"] = mail + "SELECT id, subject, 'second@example.com' AS last_to, CAST(6 AS INT) AS n FROM emails"
    sql["gmail_scan"] = mail + "SELECT id AS resource_id, thread_id, CAST(epoch_ms(date) AS BIGINT) AS internal_date FROM emails WHERE is_embedded AND date > (SELECT MIN(date) + INTERVAL '5' DAY FROM emails)"
    sql["incremental_since"] = "SELECT event_id, ts FROM events WHERE ts > (SELECT MAX(ts) FROM events WHERE event_type = 'signup')"

    # models, chunks, summaries, vectors
    sql["char_budget"] = f"""WITH m(model, kind, dim, max_tokens, i) AS (VALUES {MODEL_ROWS})
      SELECT doc_id, model, CAST(FLOOR(max_tokens * 3.5) AS INT) AS max_chars, n_chars <= FLOOR(max_tokens * 3.5) AS fits FROM documents JOIN m ON i = doc_id % 9"""
    sql["model_catalog"] = f"""WITH m(model, kind, dim, max_tokens, i) AS (VALUES {MODEL_ROWS})
      SELECT model, kind, CAST(dim AS INT) AS dim, CAST(max_tokens AS INT) AS max_tokens, COUNT(*) AS documents, CAST(SUM(CAST(n_chars <= FLOOR(max_tokens * 3.5) AS INT)) AS BIGINT) AS whole
      FROM documents JOIN m ON i = doc_id % 9 GROUP BY ALL"""
    sql["chunk_documents"] = "WITH " + chunk_ctes("documents", "doc_id") + chunk_rows("doc_id")
    thread_chunks = with_mail(DOCS, chunk_ctes("docs", "thread_id"))
    sql["chunk_threads"] = thread_chunks + chunk_rows("thread_id")
    sql["chunk_threads_resumed"] = sql["chunk_threads"]
    sql["chunk_count"] = thread_chunks + "SELECT thread_id, CAST(len(pieces) AS BIGINT) AS chunk_count FROM chunked"
    sql["summarize_gate"] = thread_chunks + "SELECT thread_id, CAST(len(pieces) AS BIGINT) AS chunk_count, len(pieces) > 3 AS is_summarized FROM chunked"
    sql["summarize_threads"] = with_mail(DOCS, summary_ctes("docs")) + "SELECT thread_id, summary FROM summaries"
    sql["summarize_threads_idf"] = with_mail(DOCS, WEIGHTS, summary_ctes("docs", weight="weights")) + "SELECT thread_id, summary FROM summaries"
    sql["summarize_hierarchical"] = hierarchical_sql(HIERARCHY_BUDGET, 2, 6)
    sql["embed_chunks"] = thread_chunks + f""", rows AS ({chunk_rows("thread_id")}),
      slots AS (SELECT thread_id, chunk_no, unnest(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'),
        lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384)) AS slot FROM rows),
      counts AS (SELECT thread_id, chunk_no, slot, COUNT(*) AS n FROM slots GROUP BY ALL),
      norms AS (SELECT thread_id, chunk_no, sqrt(SUM(n * n)) AS norm FROM counts GROUP BY ALL)
      SELECT thread_id, chunk_no, CAST(slot AS INT) AS slot, CAST(CAST(n / norm AS FLOAT) AS DOUBLE) AS weight FROM counts JOIN norms USING (thread_id, chunk_no)"""
    sql["embed_threads"] = with_mail(
        DOCS, metadata, chunk_ctes("docs", "thread_id", name="first"),
        f"scope AS (SELECT d.thread_id, d.text, len(f.pieces) AS chunk_count FROM docs d JOIN first f USING (thread_id) WHERE d.thread_id IN {pending})",
        "gated AS (SELECT * FROM scope WHERE chunk_count > 3)", summary_ctes("gated"),
        "final AS (SELECT s.thread_id, s.chunk_count, COALESCE(NULLIF(m.summary, ''), s.text) AS text FROM scope s LEFT JOIN summaries m USING (thread_id))",
        chunk_ctes("final", "thread_id"),
    ) + f"""SELECT r.thread_id, r.chunk_no, r.text, 'email' AS type, m.subject, m.sender, m.email_count, m.attachments_count, m.first_email_date, m.last_email_date,
      CAST(length(f.text) AS BIGINT) AS text_block_len, CAST(f.chunk_count AS BIGINT) AS chunk_size_original, f.chunk_count > 3 AS is_summarized
      FROM ({chunk_rows("thread_id")}) r JOIN final f USING (thread_id) JOIN meta m USING (thread_id)"""
    sql["vector_topk"] = """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
      SELECT vec_id, label, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 10"""
    sql["vector_topk_index"] = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      scored AS (SELECT q.vec_id AS question_id, r.vec_id, list_cosine_similarity(q.e, r.e) AS s FROM v q JOIN v r ON q.vec_id % 20 = 0),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY s DESC, vec_id) AS INT) AS rank FROM scored)
      SELECT question_id, rank, vec_id, ROUND(s, 6) AS score FROM ranked WHERE rank <= 10"""
    sql["embed_threads_segmented"] = sql["embed_threads"]
    sql["collection_state"] = mail + f"""SELECT thread_id, CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT) AS chunk_no,
      CASE WHEN thread_id IN {pending} AND kind <> 2 THEN 'new ' || body ELSE body END AS text
      FROM (SELECT *, CAST(regexp_extract(thread_id, '^m([0-9]+)-', 1) AS BIGINT) % 7 AS kind FROM emails)
      WHERE NOT (thread_id IN {pending} AND kind = 1)"""
    sql["collection_filter"] = mail + """SELECT thread_id, CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT) AS chunk_no, body AS text FROM emails
      WHERE thread_id = (SELECT thread_id FROM emails GROUP BY thread_id ORDER BY COUNT(*) DESC, thread_id LIMIT 1)"""
    sql["metadata_filter"] = "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20"
    sql["collection_upsert"] = mail + f"""SELECT id, thread_id, CASE WHEN thread_id IN {pending} THEN 'new ' || body ELSE body END AS text FROM emails"""

    # statistics and dumps
    lengths = docs.rstrip() + ",\n lengths AS (SELECT CAST(length(text) AS BIGINT) AS len FROM docs)\n"
    sql["length_stats"] = lengths + """SELECT COUNT(*) AS threads, ROUND(AVG(len), 6) AS mean, ROUND(quantile_cont(len, 0.5), 6) AS median, MIN(len) AS min, MAX(len) AS max,
      ROUND(quantile_cont(len, 0.9), 6) AS p90, ROUND(quantile_cont(len, 0.95), 6) AS p95, ROUND(quantile_cont(len, 0.99), 6) AS p99, ROUND(stddev_pop(len), 6) AS stddev FROM lengths"""
    sql["length_stats_sketch"] = lengths + """SELECT COUNT(*) AS threads, ROUND(AVG(len), 6) AS mean, MIN(len) AS min, MAX(len) AS max, ROUND(stddev_pop(len), 6) AS stddev,
      TRUE AS median_within, TRUE AS p90_within, TRUE AS p95_within, TRUE AS p99_within FROM lengths"""
    sql["length_histogram"] = lengths + """, kept AS (SELECT len FROM lengths WHERE len <= (SELECT quantile_cont(len, 0.95) FROM lengths)),
      r AS (SELECT MIN(len) AS lo, (MAX(len) - MIN(len)) / 80.0::DOUBLE AS w FROM kept)
      SELECT CAST(LEAST(FLOOR((len - lo) / w), 79) AS BIGINT) AS bin, COUNT(*) AS threads FROM kept, r GROUP BY 1"""
    sql["thread_dump"] = docs + f"""SELECT thread_id, array_to_string(list_transform(string_split(text, {NL}),
      lambda l: CASE WHEN {strip('l')} = '' THEN '' ELSE '         ' || l END), {NL}) AS block FROM docs"""
    sql["dump_scan"] = lengths + "SELECT len AS text_block_len, COUNT(*) AS threads FROM lengths GROUP BY len"
    return sql


ORACLES = _oracles()
