"""The numbered queries over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import annforest, chatrepair, divergence, jaccardjoin, langid, licenses, linededup, merkle, mixing, pieces, quality, simhash, substring
from tracelake.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op6_annforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chatrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatrepair.format_chats(table(spark, sf_dir, "conversations"))


def op11_jaccardjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.linked_documents(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_ALL = (op1_simhash, op2_langid, op3_mixing, op4_pieces, op5_linededup, op6_annforest, op7_quality, op8_licenses, op9_substring, op10_chatrepair, op11_jaccardjoin, op12_merkle, op13_divergence)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
_WORD = r"[^\x20\x09-\x0D]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _mix_sql() -> str:
    passes = "".join(
        rf"""
 c{k} as (select i, source, size, missing, sum(size) over (partition by source order by rank, doc_id, size, i rows unbounded preceding) upto from p{k - 1} where extra = 0 and size > 0 and size <= missing),
 t{k} as (select i, source, size from c{k} where upto <= missing), m{k} as (select source, sum(size) took from t{k} group by source),
 p{k} as (select p.* replace (case when t.i is not null then 1 else extra end as extra, missing - coalesce(took, 0) as missing) from p{k - 1} p left join t{k} t using (i) left join m{k} m on m.source is not distinct from p.source),"""
        for k in range(1, mixing.PASSES + 1)
    )
    return rf"""with d as (select row_number() over () i, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) size from documents),
 t as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) n from d group by source),
 w as (select *, {list(mixing.WEIGHTS)}[(n - 1) % {len(mixing.WEIGHTS)} + 1] weight, {mixing.EPOCHS} * source_size cap from t),
 p as (select *, coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0) used, sum(weight) over (order by cap / weight, n rows between current row and unbounded following) free, cap / weight ratio, n from w),
 l as (select ((select sum(source_size) from w) - used)::double / free::double lv from p where ((select sum(source_size) from w) - used)::double / free::double * weight <= cap order by ratio, n limit 1),
 s as (select source, source_size, least(weight * coalesce((select lv from l), 1e300), cap::double) target from w),
 h as (select *, case when source_size > 0 then least(floor(target / source_size), {mixing.EPOCHS}) else 0 end whole from s),
 p0 as (select d.*, md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || size) as rank, source_size, target, whole, target - whole * source_size missing, 0 extra from d join h on d.source is not distinct from h.source),{passes}
 b as (select i, row_number() over (partition by source order by abs(size - missing), rank, doc_id, size, i) k from p{mixing.PASSES} where extra = 0 and size > 0 and size < 2 * missing)
 select x.doc_id, size, source_size, target, cast((whole + extra + case when b.i is not null then 1 else 0 end) * size as bigint) taken from p{mixing.PASSES} x left join b on b.i = x.i and b.k = 1"""


_LINES = rf"""with d as (select row_number() over () i, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents), x as (select i, unnest(ls) line, unnest(range(1, len(ls) + 1)) p from d),
 k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') key from x),
 hot as (select key from k where key <> '' group by key having count(distinct i) >= {linededup.MIN_DOCS}),
 g as (select k.i, count(*) n_lines, count(hot.key) n_dropped, coalesce(string_agg(line, chr(10) order by p) filter (where hot.key is null), '') kept from k left join hot using (key) group by k.i)
 select doc_id, n_lines, n_dropped, sha256(kept) kept_sha256 from g join d using (i)"""


def _quality_sql() -> str:
    measures = [f"select i, '{m}' measure, case when {d} > 0 then {n} * {s} // {d} else 0 end v from st where not base_failed" for m, (n, d, s, _, _) in quality.MEASURES.items()]
    spread = "case measure " + " ".join(f"when '{m}' then {v[3]}" for m, v in quality.MEASURES.items()) + " end"
    lower = "measure in (" + ", ".join(f"'{m}'" for m, v in quality.MEASURES.items() if v[4]) + ")"

    def level(name: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return f"""{name}_c as (select {by}, value, cast(sum(n) as bigint) n from sk group by {by}, value), {name}_r as (select *, sum(n) over (partition by {by} order by value) upto, sum(n) over (partition by {by}) total from {name}_c),
 {name}_q as (select {by}, min(value) filter (where upto * 4 >= total) q1, min(value) filter (where upto * 4 >= total * 3) q3, max(total) n from {name}_r group by {by}), {name} as (select {by}, n, case when {lower} then q1 - {quality.REACH} * greatest(q3 - q1, {spread}) end lo, q3 + {quality.REACH} * greatest(q3 - q1, {spread}) hi from {name}_q)"""

    pick = lambda c: f"case when a.n >= {quality.MIN_GROUP} then a.{c} when b.n >= {quality.MIN_GROUP} then b.{c} else o.{c} end {c}"
    return rf"""with d as (select row_number() over () i, doc_id, coalesce(text, '') text, lang, source from documents), w as (select *, regexp_extract_all(text, '{_WORD}') w from d),
 win as (select i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k+7], ' '))) g, unnest(range(1, len(w) - 6)) k from w where len(w) >= 8),
 rep as (select i, k from (select i, k, count(*) over (partition by i, g) c from win) where c > 1), cov as (select i, count(distinct k + j) n from rep, (select unnest(range(0, 8)) j) group by i),
 li as (select i, line, p from (select i, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) p from d) where regexp_matches(line, '{_WORD}')),
 ld as (select i, count(*) n_lines, count(*) - count(distinct line) n_dup from li group by i),
 st0 as (select w.i, doc_id, lang, source, len(w) n_words, length(text) - length(regexp_replace(text, '{_WORD}', '', 'g')) word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup, 0) n_dup_lines, coalesce(cov.n, 0) n_repeat_words, coalesce(n_lines, 0) n_lines from w left join cov on cov.i = w.i left join ld on ld.i = w.i),
 st as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from st0),
 ms as ({" union all ".join(measures)}), sk as (select lang, source, measure, v - v % cast(pow(2, greatest(length(bin(v)) - 6, 0)) as bigint) as value, count(*) n from ms join st using (i) group by all),
 {level("fa", "lang, source")}, {level("fb", "lang")}, {level("fo", "")},
 f as (select a.lang, a.source, a.measure, {pick("lo")}, {pick("hi")} from fa a join fb b on a.lang is not distinct from b.lang and a.measure = b.measure join fo o on a.measure = o.measure),
 bad as (select distinct ms.i from ms join st using (i) join f on f.lang is not distinct from st.lang and f.source is not distinct from st.source and f.measure = ms.measure where v > hi or v < lo)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.i is null kept from st left join bad on bad.i = st.i"""


_SUBSTRINGS = rf"""with w as (select row_number() over () i, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
 win as (select i, unnest(list_transform(range(1, len(w) - {substring.WINDOW - 2}), lambda k: md5(array_to_string(w[k:k+{substring.WINDOW - 1}], ' ')))) g, unnest(range(1, len(w) - {substring.WINDOW - 2})) k from w where len(w) >= {substring.WINDOW}),
 rep as (select i, k from (select i, k, count(*) over (partition by g) c from win) where c > 1), pos as (select i, unnest(w) word, unnest(range(1, len(w) + 1)) p from w),
 edge as (select i, p, sum(d) d from (select i, k p, 1 d from rep union all select i, k + {substring.WINDOW}, -1 from rep) group by i, p),
 run as (select pos.i, pos.p, word, sum(coalesce(d, 0)) over (partition by pos.i order by pos.p) open from pos left join edge on edge.i = pos.i and edge.p = pos.p),
 kept as (select i, string_agg(word, ' ' order by p) filter (where open = 0) kept, count(*) filter (where open > 0) n_removed from run group by i)
 select doc_id, len(w) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join kept using (i)"""

_JACCARD = rf"""with recursive d as (select row_number() over () i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') w from documents),
 x as (select distinct i, unnest(case when len(w) = 0 then [] when len(w) < {jaccardjoin.SHINGLE} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {jaccardjoin.SHINGLE - 2}), lambda k: array_to_string(w[k:k+{jaccardjoin.SHINGLE - 1}], ' ')) end) g from d),
 n as (select d.i, doc_id, count(g) n from d left join x using (i) group by d.i, doc_id),
 p as (select a.i, b.i j, count(*) shared from x a join x b using (g) group by a.i, b.i),
 links as (select p.i, p.j from p join n a on a.i = p.i join n b on b.i = p.j where 100 * shared >= {round(100 * jaccardjoin.SIMILARITY)} * (a.n + b.n - shared)),
 reach as (select i, i j from n union select reach.i, links.j from reach join links on links.i = reach.j)
 select n.doc_id, n.n n_shingles, min(other.doc_id) component_id from n join reach using (i) join n other on other.i = reach.j group by n.i, n.doc_id, n.n"""


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"case when {v} is null then '-' else octet_length(encode(cast({v} as varchar))) || ':' || {v} end" for v in values) + ")"


# CRC-32 by its table of 256 entries, made from the polynomial
_MERKLE = rf"""with recursive crc as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t from (select unnest(range(256)) i)),
 d as (select row_number() over () i, *, cast(doc_id as varchar) name from documents),
 h as (select i, doc_id, case when lang is null then '-' else '=' || lang end g, {_leaf_sql("n_chars")} leaf, {_leaf_sql("n_chars + 1")} changed, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda k: ascii(name[k]))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {merkle.TAMPERED} = 0 hit from d, crc),
 r as (select *, row_number() over (partition by g order by doc_id nulls first, leaf, i) - 1 as rank, count(*) over (partition by g) n from h),
 low as (select g, 0 lvl, rank pos, leaf h, n from r union all select g, lvl + 1, pos // {merkle.FANOUT}, sha256(string_agg(h, '' order by pos)), (n + {merkle.FANOUT} - 1) // {merkle.FANOUT} from low where n > 1 group by g, lvl, n, pos // {merkle.FANOUT}),
 sub as (select g, h subroot, lvl height, row_number() over (order by g) - 1 as rank, count(*) over () n from low where n = 1),
 high as (select 0 lvl, rank pos, subroot h, n from sub union all select lvl + 1, pos // {merkle.FANOUT}, sha256(string_agg(h, '' order by pos)), (n + {merkle.FANOUT} - 1) // {merkle.FANOUT} from high where n > 1 group by lvl, n, pos // {merkle.FANOUT}),
 top as (select h root, lvl height from high where n = 1),
 f as (select r.i, doc_id, r.g, leaf, subroot, root, sub.height lh, top.height hh, r.rank lr, sub.rank hr, 0 k, '' proof, case when hit then coalesce(changed, leaf) else leaf end acc from r join sub using (g), top
  union all select f.i, doc_id, f.g, leaf, subroot, root, lh, hh, lr, hr, k + 1, proof || coalesce(low.h, high.h, ''),
   sha256(case when case when k < lh then lr >> k else hr >> (k - lh) end & 1 = 1 then coalesce(low.h, high.h, '') || acc else acc || coalesce(low.h, high.h, '') end)
  from f left join low on k < lh and low.g = f.g and low.lvl = k and low.pos = xor(lr >> k, 1) left join high on k >= lh and high.lvl = k - lh and high.pos = xor(hr >> (k - lh), 1) where k < lh + hh)
 select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, acc folded_root, acc = root verified from f where k = lh + hh"""

_DIVERGENCE = rf"""with d as (select row_number() over () i, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
 x as (select i, lang, source, unnest(w) term from d),
 kept as (select lang, term, count(*)::hugeint nl from x group by lang, term having count(distinct i) >= {divergence.MIN_DOCS}),
 v as (select lang, count(*) v, sum(nl) total from kept group by lang), g as (select distinct lang, source from d),
 c as (select lang, source, term, count(*)::hugeint n from x join kept using (lang, term) group by all), t as (select lang, source, sum(n) total from c group by all),
 p as (select g.lang, g.source, kept.term, coalesce(n, 0) n, 1 + {divergence.SCALE}::hugeint * (coalesce(n, 0) + 1) // (coalesce(t.total, 0) + v) p, 1 + {divergence.SCALE}::hugeint * (nl + 1) // (v.total + v) q
  from g join kept on kept.lang = g.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term left join t on t.lang = g.lang and t.source = g.source),
 pairs as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
 terms as (select lang, source, term item, (p - q) * (p - q) // q f from p where n > 0 and p > q),
 parts as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) f from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', item, f from terms)
 select lang, source, part, item, cast(f as bigint) as value, cast(row_number() over (partition by lang, source, part order by f desc, encode(item)) as integer) as rank from parts qualify part = 'pair' or rank <= {divergence.TERMS}"""

ORACLE_SQL: dict[str, str] = {"op11_jaccardjoin": _JACCARD, "op12_merkle": _MERKLE, "op13_divergence": _DIVERGENCE, "op3_mixing": _mix_sql(), "op5_linededup": _LINES, "op7_quality": _quality_sql(), "op9_substring": _SUBSTRINGS}
