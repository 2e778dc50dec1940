"""SQL for queries that rank the sentences of whole documents, and for the reports made of them."""

from __future__ import annotations

from ..functions.lexicons import Pack
from ..operators import report


def ranked(stops: str, steps: int = 50, tolerance: float = 1e-6) -> str:
    """CTEs over src (doc_id, sent_idx, sentence) up to fin (doc_id, sent_idx, sentence, base, wc, n), each
    document stopping on its own.  The WITH before them must be recursive."""
    return rf""",
tk AS (SELECT doc_id, sent_idx, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{Nd}}-]+')) AS term FROM src),
tf AS (SELECT doc_id, sent_idx, term, count(*) AS tf FROM tk WHERE length(term) >= 3 AND term NOT IN ({stops}) GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
nn AS (SELECT doc_id, count(*) AS n FROM src GROUP BY ALL),
raw AS (SELECT tf.doc_id, sent_idx, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS r FROM tf JOIN df USING (doc_id, term) JOIN nn USING (doc_id)
        WHERE df >= 2 AND df <= greatest(floor(0.85 * n), 2)),
ws AS (SELECT doc_id, sent_idx, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id, sent_idx)) AS w FROM raw),
up AS (SELECT a.doc_id, a.sent_idx AS src, b.sent_idx AS dst, sum(a.w * b.w) AS w FROM ws a JOIN ws b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_idx < b.sent_idx GROUP BY ALL HAVING sum(a.w * b.w) >= 0.10),
edges AS (SELECT * FROM up UNION ALL SELECT doc_id, dst, src, w FROM up),
sh AS (SELECT doc_id, src, dst, w / sum(w) OVER (PARTITION BY doc_id, src) AS share FROM edges),
pr AS (
  SELECT doc_id, sent_idx, n, 1.0::DOUBLE / n AS score, 0 AS step, false AS done FROM src JOIN nn USING (doc_id)
  UNION ALL
  SELECT doc_id, sent_idx, n, 0.15 / n + 0.85 * coalesce(got, 0), step + 1, sum(abs(0.15 / n + 0.85 * coalesce(got, 0) - score)) OVER (PARTITION BY doc_id) < {tolerance} FROM (
    SELECT p.doc_id, p.sent_idx, any_value(p.n) AS n, any_value(p.score) AS score, any_value(p.step) AS step, sum(sh.share * q.score) AS got
    FROM pr p LEFT JOIN sh ON sh.doc_id = p.doc_id AND sh.dst = p.sent_idx LEFT JOIN pr q ON q.doc_id = sh.doc_id AND q.sent_idx = sh.src
    WHERE p.step < {steps} AND NOT p.done GROUP BY p.doc_id, p.sent_idx)),
last AS (SELECT doc_id, max(step) AS step FROM pr GROUP BY ALL),
fin AS (SELECT pr.doc_id, pr.sent_idx, sentence, CASE WHEN n = 1 THEN 1.0 ELSE score END AS base, n, len(string_split_regex(sentence, '\s+')) AS wc
        FROM pr JOIN last USING (doc_id, step) JOIN src USING (doc_id, sent_idx))"""


SHAPED_LENGTH = "(CASE WHEN regexp_matches(sentence, '[0-9]') THEN 1.3 ELSE 1.0 END) * (CASE WHEN wc BETWEEN 15 AND 60 THEN 1.2 WHEN wc < 10 THEN 0.5 ELSE 1.0 END)"


def numbers(pack: Pack, limit: int) -> str:
    """CTEs over documents up to nums (doc_id, k, position, match, context, category): every hit of the three
    kinds, kept greedily in order, then the first `limit` by position."""
    def kind(name: str, pattern: str) -> str:
        p = pattern.replace("'", "''")
        return rf"""{name}0 AS (SELECT doc_id, regexp_extract_all(text, '(?i){p}') AS m, string_split_regex(text, '(?i){p}') AS b FROM documents),
{name}1 AS (SELECT doc_id, unnest(m) AS match, unnest(b[1:len(m)]) AS b, generate_subscripts(m, 1) AS i FROM {name}0),
{name} AS (SELECT doc_id, i, match, sum(length(b) + length(match)) OVER (PARTITION BY doc_id ORDER BY i) - length(match) AS position FROM {name}1)"""

    return rf"""{kind('am', pack.amount)},
{kind('dt', pack.date)},
{kind('wd', pack.word_number)},
sure AS (SELECT doc_id, list({{'p': position, 'm': match, 'c': 'AMOUNT'}} ORDER BY i) AS l FROM am GROUP BY ALL),
maybe AS (SELECT doc_id, list([{{'p': position, 'm': match, 'c': c}}] ORDER BY c, i) AS l
          FROM (SELECT *, 'DATE' AS c FROM dt UNION ALL SELECT *, 'WORD' AS c FROM wd) GROUP BY ALL),
kept AS (SELECT doc_id, list_reduce(list_concat([coalesce(sure.l, [])], coalesce(maybe.l, [])),
           lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y.p - x[1].p) < 5)) > 0 THEN acc ELSE list_concat(acc, x) END) AS l
         FROM documents LEFT JOIN sure USING (doc_id) LEFT JOIN maybe USING (doc_id)),
each AS (SELECT doc_id, unnest(l) AS h FROM kept),
placed AS (SELECT doc_id, h.p AS position, h.m AS match, h.c AS category, row_number() OVER (PARTITION BY doc_id ORDER BY h.p, h.m) AS k FROM each),
nums AS (SELECT doc_id, k, position, trim(match, ' ') AS match, category,
           trim(regexp_replace(substring(text, greatest(position - 60, 0)::BIGINT + 1, (position + length(match) + 50 - greatest(position - 60, 0))::BIGINT), '[\s\x0b\x85\p{{Z}}]+', ' ', 'g'), ' ') AS context
         FROM placed JOIN documents USING (doc_id) WHERE k <= {limit})"""


def summary(sentences: str, entities: str, stops: str, triggers: tuple[str, ...], pack: Pack) -> str:
    """CTEs up to one row per document with the lists that the reports are made of."""
    names = ", ".join(f"'{t}'" for t in triggers)
    return sentences.replace("WITH a AS", "WITH RECURSIVE a AS", 1) + rf""",
counted AS (SELECT doc_id, count(*) AS n_sentences FROM sents GROUP BY ALL),
src AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS sent_idx, sentence FROM sents WHERE len(string_split_regex(sentence, '\s+')) >= 8)""" + ranked(stops) + entities + rf""",
per AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, text) AS rank FROM ct),
pl AS (SELECT doc_id, list({{'t': text, 'n': n}} ORDER BY rank) AS people FROM per GROUP BY ALL),
tks AS (SELECT DISTINCT doc_id, unnest(list_concat([lower(text)], list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) >= 4))) AS t FROM per),
held AS (SELECT doc_id, sent_idx, count(*) AS k FROM src JOIN tks USING (doc_id) WHERE contains(lower(sentence), t) GROUP BY ALL),
boosted AS (SELECT doc_id, sent_idx, sentence, round(CASE WHEN n = 1 THEN base ELSE base * (CASE WHEN coalesce(k, 0) > 0 THEN 1.5 + 0.1 * least(k, 5) ELSE 1.0 END) * {SHAPED_LENGTH} END, 6) AS boosted
            FROM fin LEFT JOIN held USING (doc_id, sent_idx)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY boosted DESC, sent_idx) AS rank FROM boosted),
ql AS (SELECT doc_id, list({{'s': sentence, 'i': sent_idx, 'b': boosted}} ORDER BY rank) FILTER (rank <= 5) AS quotes, list({{'s': sentence, 'i': sent_idx}} ORDER BY sent_idx) FILTER (rank <= 15) AS fragments FROM best GROUP BY ALL),
rk AS (SELECT doc_id, sent_idx, sentence, list_filter([{names}], lambda x: contains(lower(sentence), x)) AS l FROM fin WHERE wc BETWEEN 5 AND 80),
rr2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(l) DESC, sent_idx) AS rank FROM rk WHERE len(l) > 0),
rl AS (SELECT doc_id, list({{'s': sentence, 'i': sent_idx, 'l': l}} ORDER BY rank) AS risks FROM rr2 WHERE rank <= 12 GROUP BY ALL),
tw AS (SELECT doc_id, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}-]+')) AS word FROM src),
tc AS (SELECT doc_id, word, count(*) AS n FROM tw WHERE length(word) >= 4 AND word NOT IN ({stops}) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM tc),
wl AS (SELECT doc_id, list({{'w': word, 'n': n}} ORDER BY rank) AS words FROM tr WHERE rank <= 12 GROUP BY ALL),
{numbers(pack, 30)},
nl AS (SELECT doc_id, list({{'p': position, 'm': match, 'c': category, 'x': context}} ORDER BY k) AS numbers FROM nums GROUP BY ALL),
s AS (SELECT doc_id, len(string_split_regex(text, '\s+')) AS n_words, length(text) AS n_chars, coalesce(n_sentences, 0) AS n_sentences, coalesce(quotes, []) AS quotes, coalesce(fragments, []) AS fragments,
        coalesce(risks, []) AS risks, coalesce(words, []) AS words, coalesce(numbers, []) AS numbers, coalesce(people, []) AS people
      FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN ql USING (doc_id) LEFT JOIN rl USING (doc_id) LEFT JOIN wl USING (doc_id) LEFT JOIN nl USING (doc_id) LEFT JOIN pl USING (doc_id))
"""


def _list(items: str, line: str, separator: str = "chr(10)") -> str:
    return f"array_to_string(list_transform({items}, lambda x, i: {line}), {separator})"


FLAT = f"""SELECT doc_id, n_words, n_chars, n_sentences, {_list('quotes', "x.i", "','")} AS quotes, round(quotes[1].b, 6) AS best_score, {_list('fragments', "x.i", "','")} AS fragments,
{_list('risks', "x.i || ':' || array_to_string(x.l, '|')", "','")} AS risks, {_list('numbers', "x.p::BIGINT || ':' || x.c || ':' || x.m", "','")} AS numbers,
{_list('words', "x.w || ':' || x.n", "','")} AS words, {_list('people', "'PER:' || x.t || ':' || x.n", "','")} AS entities FROM s"""

MARKDOWN = f"""SELECT doc_id, concat_ws(chr(10), '# Резюме интервью', '', '**Метод:** LexRank + правила (без NER)', '', '**Источник:** ' || n_words || ' слов, ' || n_sentences || ' предложений', '',
'**Время обработки:** 0.0 с', '', '---', '', '## 1. Локализация и контекст', '', '*Локации не извлечены.*',
CASE WHEN len(words) > 0 THEN chr(10) || 'Ключевые тематические слова: ' || {_list('words', 'x.w', "', '")} || '.' END, '',
'## 2. Главные действующие лица', '', CASE WHEN len(people) > 0 THEN 'По частоте упоминаний (NER):' || chr(10) END,
CASE WHEN len(people) > 0 THEN {_list('people[1:5]', "'- **' || x.t || '** — упомянут ' || x.n || ' раз'")} ELSE '*Имена не извлечены.*' END, '',
'## 3. Организации в фокусе обсуждения', '', '*Организации не извлечены.*', '',
'## 4. Ключевые цитаты из интервью', '', 'Топ-' || len(quotes) || ' предложений с наивысшим score (LexRank):', '',
CASE WHEN len(quotes) > 0 THEN {_list('quotes', "i || '. «' || x.s || '»' || chr(10)")} END,
'## 5. Все ключевые фрагменты (' || len(fragments) || ' штук в порядке появления)', '',
CASE WHEN len(fragments) > 0 THEN {_list('fragments', "i || '. ' || x.s || chr(10)")} END,
'## 6. Выявленные проблемы и риски', '', CASE WHEN len(risks) > 0 THEN 'Найдено ' || len(risks) || ' предложений с триггер-словами проблем:' || chr(10) END,
CASE WHEN len(risks) > 0 THEN {_list('risks', "'- ' || x.s || chr(10) || '  *(триггеры: `' || array_to_string(x.l, '`, `') || '`)*' || chr(10)")} ELSE 'Не найдено предложений с триггер-словами проблем.' END,
'## 7. Цифры и количественные данные', '', CASE WHEN len(numbers) > 0 THEN 'Извлечено ' || len(numbers) || ' числовых значений с контекстом:' || chr(10) END,
CASE WHEN len(numbers) > 0 THEN {_list('numbers', "'- ...' || x.x || '...'")} ELSE 'Числовые значения не найдены.' END, '',
CASE WHEN len(people) > 0 THEN concat_ws(chr(10), '## 8. Полный реестр упомянутых имён (' || len(people) || ')', '', {_list('people[1:25]', "'- ' || x.t || ' (' || x.n || 'x)'")}, '') END,
'---', '', '*Документ сгенерирован автоматически. Все факты — дословные цитаты из стенограммы.*') AS markdown FROM s"""

_RULE = "-" * 40


def _block(head: str, items: str, line: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN concat_ws(chr(10), '{head}', '{_RULE}', {_list(items, line)}, '') END"


TEXT = f"""SELECT doc_id, concat_ws(chr(10), 'РЕЗЮМЕ ИНТЕРВЬЮ', '{'=' * 60}', '', 'СТАТИСТИКА', '{_RULE}', 'Слов в стенограмме: ' || n_words, 'Предложений: ' || n_sentences,
CASE WHEN len(people) > 0 THEN 'Найдено: ' || len(people) || ' имён, 0 организаций, 0 локаций' ELSE 'Имён, организаций и локаций не обнаружено.' END, '',
{_block('ГЛАВНЫЕ ДЕЙСТВУЮЩИЕ ЛИЦА', 'people[1:15]', "'• ' || x.t || ' — ' || x.n || '×'")}, {_block('КЛЮЧЕВЫЕ ЦИТАТЫ', 'quotes', "i || '. «' || x.s || '»' || chr(10)")},
{_block('РИСКИ И ПРОБЛЕМЫ', 'risks', "'• ' || x.s || chr(10) || '  [триггеры: ' || array_to_string(x.l, ', ') || ']' || chr(10)")},
{_block('ЦИФРЫ И КОЛИЧЕСТВЕННЫЕ ДАННЫЕ', 'numbers[1:25]', "'• …' || x.x || '…'")}, '{'=' * 60}', '') AS body FROM s"""


def prompts() -> str:
    context = {
        "topic": _list("fragments[1:8]", "'- ' || x.s"), "topics": _list("fragments[1:20]", "'- ' || x.s"),
        "participants": _list("people[1:12]", "'- ' || x.t || ' (' || x.n || 'x)'") + " || chr(10) || chr(10) || 'Организации:' || chr(10)",
        "risks": f"CASE WHEN len(risks) > 0 THEN {_list('risks[1:12]', repr('- ') + ' || x.s')} ELSE {_list('fragments[11:25]', repr('- ') + ' || x.s')} END",
        "numbers": _list("numbers[1:15]", "'- ...' || x.x || '...'")}
    parts = []
    for name, c in context.items():
        title, head, ask, tokens, temperature = (x.replace("'", "''") if isinstance(x, str) else x for x in report.PROMPTS[name])
        parts.append(f"SELECT doc_id, '{name}' AS section_id, '{title}' AS section_title, '{report.SYSTEM}' AS system_message, '{head}' || chr(10) || chr(10) || {c} || chr(10) || chr(10) || '{ask}' AS user_message, "
                     f"{tokens}::INT AS max_tokens, {temperature}::DOUBLE AS temperature FROM s")
    return "\nUNION ALL ".join(parts)
