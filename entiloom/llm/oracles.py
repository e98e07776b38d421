"""SQL for DuckDB that gives the rows of queries, where SQL can express them."""

from __future__ import annotations

# The template's constants are spelled out here once more, so that a slip in the operator's own doesn't hide.
_M = "\ue000"
_UNIT_WORDS = (
    "km,kg,cm,mm,mg,ml,m,g,s,h,min,hour,hours,minute,minutes,second,seconds,day,days,week,weeks,month,months,year,years,mile,miles,feet,inches,meter,meters,metre,metres,liter,liters,litre,litres,pound,pounds,dollar,dollars,euro,euros,cent,cents,percent,"
    "stunde,stunden,minuten,sekunde,sekunden,tag,tage,tagen,woche,wochen,monat,monate,jahr,jahre,jahren,meile,meilen,kilometer,kilogramm,gramm,prozent,"
    "heure,heures,seconde,secondes,jour,jours,semaine,semaines,mois,an,ans,kilomètre,kilomètres,mètre,mètres,gramme,grammes,"
    "hora,horas,minuto,minutos,segundo,segundos,día,días,semana,semanas,mes,meses,año,años,kilómetro,kilómetros,metro,metros,gramo,gramos,litro,litros"
)
_NUMBER_WORDS = (
    "zero,one,two,three,four,five,six,seven,eight,nine,ten,eleven,twelve,thirteen,fourteen,fifteen,sixteen,seventeen,eighteen,nineteen,twenty,thirty,forty,fifty,sixty,seventy,eighty,ninety,hundred,thousand,million,billion,dozen,half,twice,double,"
    "zwei,drei,vier,fünf,sechs,sieben,acht,neun,zehn,elf,zwölf,zwanzig,dreißig,vierzig,fünfzig,hundert,tausend,"
    "deux,trois,quatre,cinq,sept,huit,neuf,dix,onze,douze,vingt,trente,quarante,cinquante,cent,mille,"
    "dos,tres,cuatro,cinco,seis,siete,ocho,nueve,diez,once,doce,veinte,treinta,cuarenta,cincuenta,cien,mil"
)
_WORDS = rf"regexp_extract_all(lower(regexp_replace(replace(coalesce(text, ''), '{_M}', ''), '(^|[^\p{{L}}])(\p{{Lu}}\p{{L}})', '\1{_M}\2', 'g')), '{_M}?\p{{L}}+|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*')"
_BARE = f"replace(x, '{_M}', '')"
# Every different word's kind once.
_SLOT = rf"""CASE WHEN regexp_matches(x, '^\p{{Nd}}') OR list_contains(string_split('{_NUMBER_WORDS}', ','), {_BARE}) THEN '{_M}n' WHEN list_contains(string_split('{_UNIT_WORDS}', ','), {_BARE}) THEN '{_M}u'
 WHEN starts_with(x, '{_M}') AND {_BARE} NOT IN (SELECT x FROM twofold) THEN '{_M}p' ELSE {_BARE} END"""
_FIVES = "list_transform(range(greatest(len(c) - 4, 0)), lambda i: array_to_string(c[i + 1 : i + 5], ' '))"

OP7 = rf"""WITH dw AS (SELECT row_number() OVER () AS dn, doc_id, {_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)), bw AS (SELECT row_number() OVER () AS bn, item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
 bx AS (SELECT bn, unnest(w) AS x, unnest(range(len(w))) AS i FROM bw), dx AS (SELECT dn, unnest(w) AS x, unnest(range(len(w))) AS i FROM dw),
 twofold AS (SELECT {_BARE} AS x FROM bx GROUP BY 1 HAVING count(DISTINCT starts_with(bx.x, '{_M}')) = 2), kinds AS (SELECT x, {_SLOT} AS k FROM (SELECT x FROM bx UNION SELECT x FROM dx)),
 dt AS (SELECT dn, list(k ORDER BY i) AS c FROM dx JOIN kinds USING (x) GROUP BY dn), bt AS (SELECT bn, list(k ORDER BY i) AS c FROM bx JOIN kinds USING (x) GROUP BY bn),
 d AS (SELECT dn, doc_id, w, {_FIVES} AS win FROM dw JOIN dt USING (dn)), b AS (SELECT bn, item_id, w, c, {_FIVES} AS win FROM bw JOIN bt USING (bn)),
 dp AS (SELECT dn, unnest(win) AS h, unnest(range(len(win))) AS p FROM d), bp AS (SELECT bn, unnest(win) AS h, unnest(range(len(win))) AS i FROM b),
 pairs AS (SELECT dn, bn, count(DISTINCT dp.h) AS n FROM dp JOIN bp ON dp.h = bp.h GROUP BY dn, bn),
 totals AS (SELECT bn, count(DISTINCT h) AS total, count(*) AS places FROM bp GROUP BY bn),
 found AS (SELECT dn, pairs.bn, n, total, places FROM pairs JOIN totals ON pairs.bn = totals.bn WHERE n >= total * 0.8),
 m AS (SELECT f.dn, f.bn, places, i, p - i AS o FROM found f JOIN bp ON bp.bn = f.bn JOIN dp ON dp.dn = f.dn AND dp.h = bp.h),
 cover AS (SELECT dn, bn, o, count(*) AS n, max(places) AS places FROM m GROUP BY dn, bn, o),
 anchors AS (SELECT dn, bn, o AS a FROM cover WHERE n >= places * 0.8 UNION SELECT dn, bn, arg_min(o, (-n, o)) FROM cover GROUP BY dn, bn),
 spot AS (SELECT a.dn, a.bn, a.a, m.i, m.o, row_number() OVER (PARTITION BY a.dn, a.bn, a.a, m.i ORDER BY abs(m.o - a.a), m.o) AS r FROM anchors a JOIN m ON m.dn = a.dn AND m.bn = a.bn),
 word AS (SELECT dn, bn, a, i + k AS j, o, row_number() OVER (PARTITION BY dn, bn, a, i + k ORDER BY abs(o - a), o) AS r FROM spot CROSS JOIN (SELECT unnest(range(5)) AS k) WHERE r = 1),
 slots AS (SELECT x.dn, x.bn, x.a, b.w[j + 1] AS item, b.c[j + 1] || ' ' || d.w[j + o + 1] AS doc FROM word x JOIN b ON b.bn = x.bn JOIN d ON d.dn = x.dn WHERE r = 1 AND starts_with(b.c[j + 1], '{_M}')),
 agreed AS (SELECT dn, bn, a, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS g FROM (SELECT dn, bn, a, item, count(DISTINCT doc) AS n FROM slots GROUP BY dn, bn, a, item) GROUP BY dn, bn, a),
 best AS (SELECT dn, bn, max(g) AS g FROM agreed GROUP BY dn, bn)
 SELECT DISTINCT doc_id, item_id, n AS n_matched, total AS n_windows, n / total AS coverage, coalesce(g, 1.0) AS agreement FROM found f JOIN d ON d.dn = f.dn JOIN b ON b.bn = f.bn
 LEFT JOIN best ON best.dn = f.dn AND best.bn = f.bn WHERE coalesce(g, 1.0) >= 0.8"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10 = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(greatest(len(w) - 3, 0)), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS h FROM words),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
 least AS (SELECT a, min(b) AS c FROM r GROUP BY a)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON a = d.doc_id"""

# Every string of 400 bytes of every text by a 128-bit digest; a byte is two characters of hex. Texts are taken in pieces
# of 2,048 places, as DuckDB walks a string from its start.
OP2 = """WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT r, doc_id, h, len(h) // 2 AS n FROM t),
 piece AS (SELECT r, base, substr(h, 2 * base + 1, 4894) AS s, least(2048, n - 399 - base) AS m FROM (SELECT r, h, n, unnest(range(0, greatest(n - 399, 0), 2048)) AS base FROM n)),
 k AS (SELECT r, base + i AS i, md5_number(substr(s, 2 * i + 1, 800)) AS m FROM (SELECT r, base, s, unnest(range(m)) AS i FROM piece)),
 twice AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1), hit AS (SELECT r, i FROM k SEMI JOIN twice ON k.m = twice.m),
 part AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM hit)),
 cut AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM part GROUP BY r, g), lost AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM cut GROUP BY r),
 keep AS (SELECT r, e AS a, lead(s) OVER (PARTITION BY r ORDER BY e) AS b FROM (SELECT r, s, e FROM cut UNION ALL SELECT r, 0, 0 FROM n)),
 left_over AS (SELECT keep.r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM keep JOIN n ON n.r = keep.r GROUP BY keep.r)
 SELECT doc_id, n AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(left_over.h)) AS kept_sha256 FROM n JOIN left_over ON left_over.r = n.r LEFT JOIN lost ON lost.r = n.r"""

OP12 = OP10.replace("100 * c >= 80 *", "100 * c >= 85 *").replace(", d.doc_id = c AS kept", "")

# The crc32 of each different word, byte by byte from the table of the polynomial.
OP13 = f"""WITH tbl AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM (SELECT unnest(range(256)) AS b))),
 d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 dw AS (SELECT r, unnest(w) AS x FROM d), bw AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark),
 kinds AS (SELECT DISTINCT x FROM (SELECT x FROM dw UNION ALL SELECT x FROM bw)), bytes AS (SELECT x, list_transform(range(len(hex(encode(x))) // 2), lambda i: cast('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT)) AS b FROM kinds),
 bucket AS (SELECT x, xor(list_reduce(b, lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM bytes, tbl),
 s AS (SELECT k, count(*) AS n FROM dw JOIN bucket USING (x) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN bucket USING (x) GROUP BY k),
 gain AS (SELECT k, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS g FROM s FULL JOIN t USING (k)),
 w AS (SELECT r, count(*) AS n, cast(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN bucket USING (x) JOIN gain USING (k) GROUP BY r),
 o AS (SELECT r, d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
 p AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
 q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM p WHERE n_features >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM q) THEN rank END AS rank FROM p LEFT JOIN q USING (r)"""

OP11 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS a, a.label AS al, b.vec_id AS b, b.label AS bl, cast(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT * FROM (SELECT a, b, s, al, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE al = bl) WHERE r <= 5),
 n AS (SELECT p.a, p.b AS pos, p.s AS ps, s.b AS neg, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a WHERE s.al <> s.bl AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
 SELECT a AS anchor_id, pos AS positive_id, cast(r AS INTEGER) AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5"""

SQL = {"op2_suffix_dedup": OP2, "op7_decontamination": OP7, "op10_near_dups": OP10, "op11_hard_negatives": OP11, "op12_jaccard_join": OP12, "op13_importance": OP13}
