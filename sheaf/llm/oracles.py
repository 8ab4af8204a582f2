"""DuckDB SQL of the queries that SQL can express on whole tables.

Not here: sharding by bytes, BPE and token files (no SQL form), the language model
and the distances of quality rules (tests hold them against plain versions).
"""

from __future__ import annotations

from sheaf.llm.licenses import K, LEAST, NEXT, NOTICES, PHRASES

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_LETTERS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPS = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w)>=4 THEN list_transform(range(1,len(w)-2), lambda i: array_to_string(w[i:i+3],' ')) WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*common >= 80*(x.n+y.n-common)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a=r.seen),
 c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
 SELECT w.doc_id, coalesce(n.n,0) AS n_shingles, component_id, w.doc_id=component_id AS kept FROM w LEFT JOIN n ON n.doc_id=w.doc_id JOIN c ON c.node=w.doc_id"""

CONTAMINATION = f"""WITH i AS (SELECT item_id, {_LETTERS} AS w FROM benchmark), d AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
 iw AS (SELECT DISTINCT item_id, least(10,len(w)) AS m, array_to_string(w[k:k+least(10,len(w))-1],' ') AS t FROM (SELECT *, unnest(range(1,len(w)-least(10,len(w))+2)) AS k FROM i WHERE len(w)>0)),
 dw AS (SELECT doc_id, m, k, array_to_string(w[k:k+m-1],' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1,len(w)-m+2)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w)>=m)),
 h AS (SELECT doc_id, k, dw.m AS m, item_id FROM dw JOIN iw ON iw.t=dw.t AND iw.m=dw.m),
 hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k,k+m)) AS x FROM h) GROUP BY 1),
 hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text,'')")} AS w FROM documents),
 g AS (SELECT doc_id, k, array_to_string(w[k:k+49],' ') AS t FROM (SELECT doc_id, w, unnest(range(1,len(w)-48)) AS k FROM d WHERE len(w)>=50)),
 f AS (SELECT t, min(doc_id) AS least FROM g GROUP BY 1 HAVING min(doc_id)<max(doc_id)),
 x AS (SELECT DISTINCT doc_id, unnest(range(k,k+50)) AS p FROM g JOIN f USING (t) WHERE least<doc_id),
 u AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1,len(w)+1)) AS p FROM d)),
 y AS (SELECT u.doc_id, count(x.p) AS n_removed, string_agg(word, ' ' ORDER BY u.p) FILTER (x.p IS NULL) AS kept FROM u LEFT JOIN x ON x.doc_id=u.doc_id AND x.p=u.p GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed,0) AS n_removed, sha256(coalesce(kept,'')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"""


def licenses() -> str:
    """The same votes in SQL, from the same templates."""
    rows = [(f"phrase {label}: {t}", label, "true", t) for t, label in PHRASES.items()] + [(f"notice {label}", label, "false", t) for label, t in NOTICES.items()]
    grams = ",".join(f"('{name}','{label}',{phrase},{len(t.split())},{p},'{' '.join(t.split()[p : p + K])}')" for name, label, phrase, t in rows for p in range(len(t.split()) - K + 1))
    return f"""WITH t(template,label,phrase,n,tp,g) AS (VALUES {grams}), d AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
 v AS (SELECT doc_id, template, label, phrase, n, k-1-tp AS diagonal, count(*) AS votes, min(k-1) AS first, max(k-1) AS last, list(DISTINCT tp) AS places FROM (SELECT doc_id, w, unnest(range(1,len(w)-{K - 2})) AS k FROM d WHERE len(w)>={K}) x JOIN t ON t.g=array_to_string(x.w[k:k+{K - 1}],' ') GROUP BY ALL),
 o AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal-lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal)>{NEXT},true) THEN 1 ELSE 0 END AS apart FROM v WHERE NOT phrase OR votes=n-{K - 1}),
 c AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM o),
 s AS (SELECT doc_id, label, phrase, min(first) AS start, max(last)+{K} AS stop, n, len(list_distinct(flatten(list(places))))/(n-{K - 1}) AS share FROM c GROUP BY doc_id, template, label, phrase, n, cluster),
 f AS (SELECT * FROM s WHERE phrase OR (share>={LEAST} AND stop-start<=2*n)),
 a AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share)::DOUBLE AS score FROM f GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base,0) AS n_base, first_word, last_word, coalesce(base_labels,'') AS base_labels, coalesce(labels,'') AS labels, coalesce(score,0) AS score FROM d LEFT JOIN a USING (doc_id)"""
