"""DuckDB SQL of the queries that SQL can say.

Not said: the tokenizer (1, 6), the tiling loop (2), the fitted classifier (4), XXH64 (5) and CRC-32
(10), which DuckDB lacks; tests hold those against brute force.
"""

from __future__ import annotations

from tiergraph.llm import op03_warc_fixity as op3
from tiergraph.llm import op07_rule_ledger as op7
from tiergraph.llm import op08_line_dedup as op8
from tiergraph.llm import op09_license_rules as op9

HAS_WORD = r"regexp_matches({c}, '[^\x20\x09-\x0D]')"
NEWLINE = "chr(10)"


def _rules() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(op7.RULES))
    return f"CAST({bits} AS BIGINT)"


def rule_ledger() -> str:
    n = op7.WINDOW_WORDS
    only = " ".join(f"WHEN {op7.mask_of([r])} THEN '{r}'" for r in op7.POLICIES[op7.PRODUCTION])
    base, counts = op7.mask_of(op7.BASE_RULES), op7.mask_of(op7.POLICIES[op7.PRODUCTION])
    return rf"""WITH t AS (SELECT doc_id, COALESCE(text,'') AS text, row_number() OVER () AS r FROM documents),
 w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text,'[\x20\x09-\x0D]+'), lambda x: x<>'') AS ws, list_filter(string_split(text,{NEWLINE}), lambda x: {HAS_WORD.format(c="x")}) AS ls FROM t),
 v AS (SELECT r, i, hash(array_to_string(ws[i:i+{n - 1}],' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws)-{n}+2)) AS i FROM w WHERE len(ws)>={n})),
 d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS k FROM v) WHERE k>1),
 c AS (SELECT r, count(DISTINCT i+j) AS covered FROM d, (SELECT unnest(range({n})) AS j) GROUP BY r),
 m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws,'')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text,'[^#*$%&|<>]+','','g')) AS BIGINT) AS n_symbols,
  CAST(len(ls)-len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(covered,0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines FROM w LEFT JOIN c ON w.r=c.r),
 f AS (SELECT *, {_rules()} AS failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {base})<>0 AS base_failed, (failed & {base})=0 AND (failed & {counts})=0 AS kept, failed, CASE failed & {counts} {only} END AS only_rule FROM f"""


def line_dedup() -> str:
    return rf"""WITH l AS (SELECT doc_id, no, line, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text,{NEWLINE})) AS line, generate_subscripts(string_split(text,{NEWLINE}),1) AS no FROM documents WHERE text IS NOT NULL)),
 o AS (SELECT *, doc_id*1000000+no AS place FROM l WHERE {HAS_WORD.format(c="line")}),
 d AS (SELECT line, min(n) AS n, min(place) AS first FROM o GROUP BY line),
 k AS (SELECT line, n, first, s, side, CASE WHEN side=0 THEN line[1:(s-1)//2] ELSE line[n-(s-1)//2+1:n] END AS half FROM (SELECT *, unnest([n, n-1]) AS s FROM d WHERE n>={op8.MIN_CHARS}), (VALUES (0),(1)) x(side)),
 near AS (SELECT DISTINCT a.line AS line FROM k a JOIN k b ON a.s=b.s AND a.side=b.side AND a.half=b.half AND b.first<a.first AND abs(a.n-b.n)<=1 WHERE levenshtein(a.line,b.line)<=1),
 j AS (SELECT o.doc_id AS doc_id, o.no AS no, o.place<>d.first AS exact, near.line IS NOT NULL AND o.place=d.first AS near FROM o JOIN d ON o.line=d.line LEFT JOIN near ON o.line=near.line),
 s AS (SELECT l.doc_id AS doc_id, count(j.no) AS n_lines, count_if(exact) AS n_exact, count_if(near) AS n_near, string_agg(CASE WHEN NOT COALESCE(exact OR near,false) THEN line END, {NEWLINE} ORDER BY l.no) AS text FROM l LEFT JOIN j ON l.doc_id=j.doc_id AND l.no=j.no GROUP BY l.doc_id)
 SELECT documents.doc_id AS doc_id, COALESCE(n_lines,0) AS n_lines, COALESCE(n_exact,0) AS n_exact, COALESCE(n_near,0) AS n_near, CASE WHEN documents.text IS NULL THEN NULL ELSE COALESCE(s.text,'') END AS text FROM documents LEFT JOIN s ON documents.doc_id=s.doc_id"""


def license_rules() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(s)}: {q(i)}" for s, i in op9.SENTENCES.items()) + "}"
    rest, steps = "seq", []
    for k, (ids, _) in enumerate(op9.RULES):
        steps.append(f"r{k + 1} AS (SELECT *, replace({rest}, {q(op9.rule_pattern(ids))}, '/') AS rest{k + 1} FROM r{k})")
        rest = f"rest{k + 1}"
    hits = ", ".join(f"CASE WHEN rest{k + 1}<>{'seq' if k == 0 else f'rest{k}'} THEN {q(name)} END" for k, (_, name) in enumerate(op9.RULES))
    low = r"regexp_replace(lower(COALESCE(text,'')), '[ \t\r\x0b\f]+', ' ', 'g')"
    return rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({low}, '\n|[.!?;]+(?:[ \t\r]+|$|\n)'), lambda x: trim(rtrim(trim(x),':'))), lambda x: x<>'') AS parts FROM documents),
 i AS (SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_sentences, list_filter(list_transform(parts, lambda x: ({known})[x]), lambda x: x IS NOT NULL) AS ids FROM p),
 r0 AS (SELECT doc_id, n_sentences, CAST(len(ids) AS BIGINT) AS n_known, COALESCE(array_to_string(list_transform(ids, lambda x: '<'||x||'>'),''),'') AS seq FROM i),
 {", ".join(steps)}
 SELECT doc_id, n_sentences, n_known, seq AS sequence, COALESCE(array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))),','),'') AS licenses, CAST(length({rest})-length(replace({rest},'<','')) AS BIGINT) AS unmatched FROM r{len(op9.RULES)}"""


def warc_fixity() -> str:
    """The usual case: each id once."""
    rn = "chr(13)||chr(10)"
    record = (
        f"'WARC/1.1'||{rn}||'WARC-Type: resource'||{rn}||'WARC-Date: {op3.DATE}'||{rn}||'WARC-Record-ID: <urn:page:'||page_id||'>'||{rn}||'WARC-Target-URI: '||regexp_replace(COALESCE(url,''),'[\\r\\n]','','g')||{rn}"
        f"||'Content-Type: text/html'||{rn}||'Content-Length: '||strlen(COALESCE(html,''))||{rn}||{rn}||COALESCE(html,'')||{rn}||{rn}"
    )
    joined = "sha256(string_agg({key}||':'||lo||':'||hi||':'||digest, chr(10) ORDER BY {key}))"

    def tree(p: str, pages: str) -> str:
        out = [
            f"{p}r AS (SELECT page_id, page_id//{op3.PER_FILE} AS file, {record} AS rec FROM {pages})",
            f"""{p}l AS (SELECT page_id, file, row_number() OVER w - 1 AS ordinal, CAST(COALESCE(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id, sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS "offset", CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM {p}r WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256(rec)))""",
            f"""{p}n0 AS (SELECT file, ordinal AS node, digest, "offset" AS lo, "offset"+length AS hi FROM {p}l)""",
        ]
        span, level = 1, 0
        while span < op3.PER_FILE * op3.FAN:
            level, span = level + 1, span * op3.FAN
            out.append(f"{p}n{level} AS (SELECT file, node//{op3.FAN} AS node, {joined.format(key='node')} AS digest, min(lo) AS lo, max(hi) AS hi FROM {p}n{level - 1} GROUP BY file, node//{op3.FAN})")
        out.append(f"{p}f AS (SELECT CAST(floor(file/{op3.DIRECTORY}) AS BIGINT) AS folder, {joined.format(key='file')} AS digest, CAST(sum(lo) AS BIGINT) AS lo, CAST(sum(hi) AS BIGINT) AS hi FROM {p}n{level} GROUP BY 1)")
        out.append(f"{p}t AS (SELECT {joined.format(key='folder')} AS replica FROM {p}f)")
        return ",\n ".join([*out, f"{p}root AS (SELECT file, digest AS root FROM {p}n{level})"])

    return f"""WITH spoiled AS (SELECT page_id, url, CASE WHEN starts_with(sha256(CAST(page_id AS VARCHAR)),'00') THEN translate(html,'aeiou','eioua') ELSE html END AS html FROM pages WHERE NOT starts_with(sha256(CAST(page_id AS VARCHAR)),'ab')),
 {tree("m_", "pages")},
 {tree("o_", "spoiled")}
 SELECT m.page_id AS page_id, m.file AS file, m.ordinal AS ordinal, m."offset" AS "offset", m.length AS length, m.digest AS digest, m_root.root AS root, o_root.root AS other_root, m_t.replica AS replica, o_t.replica AS other_replica,
  CASE WHEN o.page_id IS NULL THEN 'missing' WHEN m.digest<>o.digest THEN 'corrupt' WHEN m.ordinal<>o.ordinal THEN 'moved' ELSE 'ok' END AS status
 FROM m_l m LEFT JOIN o_l o ON m.page_id=o.page_id JOIN m_root ON m.file=m_root.file LEFT JOIN o_root ON m.file=o_root.file, m_t, o_t"""


SQL: dict[str, str] = {
    "op3_warc_fixity": warc_fixity(),
    "op7_rule_ledger": rule_ledger(),
    "op8_line_dedup": line_dedup(),
    "op9_license_rules": license_rules(),
}
