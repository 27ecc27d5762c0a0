"""The registered queries as DuckDB SQL over the same tables.

Each query is a chain of named steps; ``chain`` puts the steps a query needs in front of
it. Term lists and phrases are the shared fixed values, everything else is written anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from crowdread.functions import lexicon
from crowdread.plans.fixtures import FIRST_LABELS, PHRASES, SECOND_LABELS, SEQUENCES, TITLES
from crowdread.schema import EMOTIONS, INTENTS, SEGMENTS, SENTIMENTS

WS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
EMOJI = r"[\x{2600}-\x{27bf}\x{2b50}\x{2b55}\x{1f300}-\x{1faff}]"
VIDEO_ID = "([A-Za-z0-9_-]{11})"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return ", ".join(lit(v) for v in values)


def pick(values: Sequence[str], index: str) -> str:
    return f"list_extract([{listed(values)}], CAST({index} AS INT) + 1)"


def any_of(col: str, name: str) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(t)})" for t in lexicon.terms(name)) + ")"


def count_of(col: str, name: str) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {lit(t)}) AS INT)" for t in lexicon.terms(name)) + ")"


def first_of(col: str, rules: Sequence[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN {any_of(col, name)} THEN {lit(label)}" for name, label in rules)
    return f"CASE {whens} ELSE {default} END"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def more_words(col: str, n: int) -> str:
    return f"regexp_matches({col}, '^[{WS}]*([^{WS}]+[{WS}]+){{{n}}}[^{WS}]')"


def emoji_words(col: str) -> str:
    named = f"replace({col}, '️', '')"
    for sign, name in lexicon.EMOJI_NAMES.items():
        named = f"replace({named}, {lit(sign)}, {lit(f' {name} ')})"
    for sign, name in lexicon.SKIN_TONES.items():
        named = f"replace({named}, {lit(f' {sign}')}, {lit(f'_{name} ')})"
    return f"CASE WHEN regexp_matches({col}, '{EMOJI}') THEN {named} ELSE {col} END"


def cleaned(col: str) -> str:
    unlinked = f"regexp_replace({col}, 'http[^{WS}]+|www[^{WS}]+', '', 'g')"
    return emoji_words(f"trim(regexp_replace({unlinked}, '[{WS}]+', ' ', 'g'))")


def group_of(col: str) -> str:
    whens = " ".join(
        f"WHEN {col} IN ({listed(members)}) THEN {lit(group)}"
        for group, members in lexicon.FINE_EMOTIONS.items()
        if group != "neutral"
    )
    return f"CASE {whens} ELSE 'neutral' END"


def valid(emotion: str, sentiment: str) -> str:
    return (
        f"CASE {sentiment} WHEN 'positive' THEN {emotion} IN ('joy', 'surprise', 'neutral') "
        f"WHEN 'negative' THEN {emotion} IN ('anger', 'sadness', 'fear', 'disgust', 'neutral') "
        "ELSE true END"
    )


def first_valid(candidates: Sequence[str], sentiment: str) -> str:
    whens = " ".join(f"WHEN {valid(c, sentiment)} THEN {c}" for c in candidates)
    return (
        f"CASE {whens} WHEN {sentiment} = 'positive' THEN 'joy' "
        f"WHEN {sentiment} = 'negative' THEN 'anger' ELSE 'neutral' END"
    )


def points(*parts: tuple[str, str]) -> str:
    return " + ".join(f"CASE WHEN {test} THEN {value} ELSE 0.00 END" for test, value in parts)


RULES = [
    ("RULE_THANKS", "joy"), ("RULE_DELIGHT", "joy"), ("RULE_SURPRISE", "surprise"),
    ("RULE_FEAR", "fear"), ("RULE_SADNESS", "sadness"), ("RULE_ANGER", "anger"),
]
INTENT_RULES = [
    ("INTENT_QUESTION", "question"), ("INTENT_SUGGESTION", "suggestion"),
    ("INTENT_PRAISE", "praise"), ("INTENT_COMPLAINT", "complaint"),
]
BY_SENTIMENT = "CASE sentiment WHEN 'positive' THEN 'joy' WHEN 'negative' THEN 'anger' ELSE 'neutral' END"

COMMENTS = f"""
SELECT comment_id, video_id, CASE WHEN lvl <> 0 THEN comment_id - 40 * lvl END AS parent_id,
       lvl <> 0 AS is_reply, lang,
       CASE WHEN form = 0 THEN ph || ' ' || body WHEN doc_id % 7 = 0 THEN upper(ph) ELSE ph END AS text,
       CASE WHEN comment_id % 50 <> 49 THEN (comment_id * 37) % 601 END AS like_count,
       round(p / (p + n + u + 1e0), 4) AS positive_score,
       round(n / (p + n + u + 1e0), 4) AS negative_score,
       round((u + 1) / (p + n + u + 1e0), 4) AS neutral_score,
       {pick(FIRST_LABELS, "(comment_id * 11) % 9")} AS emo1,
       round(((comment_id * 17) % 100) / 100e0, 4) AS s1,
       {pick(SECOND_LABELS, "(comment_id * 5) % 7")} AS emo2,
       round((100 - (comment_id * 17) % 100) * 0.3e0 / 100e0, 4) AS s2,
       CASE WHEN comment_id % 9 < 3 THEN 'toxic' WHEN comment_id % 9 = 3 THEN 'insult'
            ELSE 'other' END AS toxic_label,
       round(((comment_id * 31) % 101) / 100e0, 4) AS toxic_raw,
       CASE WHEN comment_id % 4 < 2 THEN 'irony' ELSE 'non_irony' END AS irony_label,
       round(0.5e0 + ((comment_id * 19) % 51) / 100e0, 4) AS irony_raw
FROM (SELECT doc_id, source AS video_id, lang, text AS body, form, comment_id,
             (doc_id // 20) % 4 AS lvl, {pick(PHRASES, "(doc_id + doc_id // 20) % 20")} AS ph,
             (comment_id * 13) % 101 AS p, (comment_id * 29) % 101 AS n, (comment_id * 53) % 101 AS u
      FROM (SELECT *, 0 AS form, doc_id * 2 AS comment_id FROM documents
            UNION ALL SELECT *, 1 AS form, doc_id * 2 + 1 AS comment_id FROM documents) f) b
"""

VIDEOS = f"""
SELECT video_id, vn, {pick(TITLES, "vn % 7")} AS title,
       'channel' || CAST(vn % 4 AS VARCHAR) AS channel
FROM (SELECT DISTINCT source AS video_id, CAST(substring(source, 4) AS INT) AS vn FROM documents) v
"""


def sentiment_step(source: str) -> str:
    return f"""
SELECT *, CASE WHEN positive_score >= negative_score AND positive_score >= neutral_score
               THEN 'positive' WHEN negative_score >= neutral_score THEN 'negative'
               ELSE 'neutral' END AS sentiment,
       {group_of("emo1")} AS g1, {group_of("emo2")} AS g2, lower(text) AS t
FROM {source}"""


PARSED = f"""
SELECT *, CASE WHEN clean_text = '' THEN text ELSE clean_text END AS working_text
FROM (SELECT *, {cleaned("text")} AS clean_text
      FROM (SELECT *, row_number() OVER (PARTITION BY video_id, {strip("lower(text)")} ORDER BY comment_id) AS rn
            FROM comments WHERE length({strip("text")}) > 3 AND {strip("lower(text)")} <> '') k
      WHERE rn = 1) c
"""


def language_step(source: str, text: str) -> str:
    hits = ", ".join(
        f"len(list_filter(words, lambda w: w IN ({listed(ws)}))) AS n_{lang}"
        for lang, ws in lexicon.LANGUAGE_WORDS.items()
    )
    places = [*lexicon.LANGUAGE_WORDS, "hi", "ur"]
    best = "greatest(" + ", ".join(f"n_{p}" for p in places) + ")"
    whens = " ".join(f"WHEN n_{p} = {best} THEN {lit(p)}" for p in places)
    return f"""
SELECT *, CASE WHEN {any_of("low", "HINGLISH_MARKERS")} THEN 'hinglish' WHEN {best} = 0 THEN 'unknown'
               {whens} END AS language
FROM (SELECT *, {hits},
             len(regexp_extract_all({text}, '[\\x{{0900}}-\\x{{097f}}]+')) AS n_hi,
             len(regexp_extract_all({text}, '[\\x{{0600}}-\\x{{06ff}}]+')) AS n_ur
      FROM (SELECT *, lower({text}) AS low, regexp_extract_all(lower({text}), '\\p{{L}}+') AS words
            FROM {source}) a) b"""


def emotion_steps(source: str, col: str) -> str:
    """raw_top, group sums and the rule-corrected model emotion from lower-cased ``col``."""
    sums = ", ".join(
        f"CASE WHEN g1 = '{e}' THEN s1 ELSE 0e0 END + CASE WHEN g2 = '{e}' THEN s2 ELSE 0e0 END AS {e}"
        for e in EMOTIONS
    )
    return f"""
SELECT *, CASE WHEN first_emotion IN ('anger', 'sadness') AND NOT {any_of(col, "GENUINE_ANGER")}
                    AND ({any_of(col, "PRAISE_NEGATION")}
                         OR (sentiment = 'positive' AND {any_of(col, "PRAISE_WORDS")}))
               THEN 'joy' ELSE first_emotion END AS emotion_model_rule
FROM (SELECT *, CASE WHEN top_score >= 0.30e0 THEN top_emotion
                     ELSE {first_of(col, RULES, BY_SENTIMENT)} END AS first_emotion
      FROM (SELECT *, CASE WHEN s1 >= s2 THEN emo1 ELSE emo2 END AS raw_top,
                   CASE WHEN g1 = g2 OR s1 >= s2 THEN g1 ELSE g2 END AS top_emotion,
                   CASE WHEN g1 = g2 THEN s1 + s2 ELSE greatest(s1, s2) END AS top_score, {sums}
            FROM {source}) a) b"""


TOXIC_SCORE = "round(CASE WHEN toxic_label = 'toxic' THEN toxic_raw ELSE 1 - toxic_raw END, 4)"
IS_TOXIC = f"(toxic_label = 'toxic' AND {TOXIC_SCORE} >= 0.85e0)"
SARCASM_SCORE = "CASE WHEN irony_label = 'irony' THEN irony_raw ELSE round(1 - irony_raw, 4) END"
PLAIN_SARCASTIC = "(irony_label = 'irony' AND irony_raw >= 0.92e0)"


def sarcastic(low: str, text: str) -> str:
    return (
        f"CASE WHEN {any_of(low, 'SARCASM_SIGNALS')} THEN {PLAIN_SARCASTIC} "
        f"WHEN {any_of(low, 'SINCERE_MARKERS')} THEN false "
        f"WHEN irony_raw < 0.95e0 AND NOT {more_words(text, 8)} THEN false ELSE {PLAIN_SARCASTIC} END"
    )


VOTE_SENTIMENT = (
    "CASE sentiment WHEN 'positive' THEN 'joy' WHEN 'negative' THEN "
    "CASE WHEN negative_score > 0.70e0 THEN 'anger' ELSE 'sadness' END ELSE 'neutral' END"
)
VOTE_KEYWORDS = first_of("t", [(v, k) for k, v in lexicon.KEYWORD_EMOTIONS.items()], "'neutral'")


def vote_steps(source: str) -> str:
    winner = "CASE WHEN vote_sentiment = vote_keywords THEN vote_sentiment ELSE vote_model END"
    settled = first_valid(["winner", "vote_model", "vote_sentiment", "vote_keywords"], "sentiment")
    return f"""
SELECT *, {settled} AS dominant_emotion
FROM (SELECT *, {winner} AS winner,
             vote_model <> vote_sentiment AND vote_sentiment <> vote_keywords
             AND vote_model <> vote_keywords AS conflict
      FROM (SELECT *, CASE WHEN g1 = g2 OR s1 >= s2 THEN g1 ELSE g2 END AS vote_model,
                   {VOTE_SENTIMENT} AS vote_sentiment, {VOTE_KEYWORDS} AS vote_keywords
            FROM {source}) a) b"""


def corrected_step(source: str) -> str:
    return f"""
SELECT * REPLACE (
         CASE rule WHEN 0 THEN sentiment ELSE 'positive' END AS sentiment,
         CASE rule WHEN 1 THEN greatest(positive_score, 0.72e0) WHEN 3 THEN greatest(positive_score, 0.58e0)
                   WHEN 2 THEN greatest(positive_score, 0.60e0) ELSE positive_score END AS positive_score,
         CASE rule WHEN 1 THEN least(negative_score, 0.12e0) WHEN 3 THEN least(negative_score, 0.22e0)
                   WHEN 2 THEN least(negative_score, 0.20e0) ELSE negative_score END AS negative_score)
FROM (SELECT *, sentiment AS scored_sentiment,
             CASE WHEN {any_of("t", "HINGLISH_POSITIVE")} THEN 1
                  WHEN {count_of("t", "POSITIVE_EMOJI")} >= 2 AND negative_score > positive_score THEN 3
                  WHEN {any_of("t", "REQUEST_WORDS")} AND {any_of("t", "COMPLIMENT_WORDS")}
                       AND negative_score > positive_score THEN 2 ELSE 0 END AS rule
      FROM {source}) a"""


GENUINE_QUESTION = (
    f"CASE WHEN {any_of('t', 'PRAISE_WITH_QUESTION_WORD')} THEN false "
    f"WHEN {any_of('t', 'HELP_REQUESTS')} OR {any_of('t', 'CURIOUS_MARKERS')} THEN true "
    "WHEN NOT contains(text, '?') THEN false "
    "WHEN " + " OR ".join(f"starts_with(lower({strip('text')}), {lit(o)})" for o in lexicon.QUESTION_OPENERS)
    + f" THEN true ELSE NOT {more_words('text', 15)} END"
)


def axes_step(source: str) -> str:
    praise = "(intent = 'praise' OR positive_score > 0.70e0)"
    rhetorical = "(blames AND negative_score > 0.55e0)"
    return f"""
SELECT *,
       CAST(round(CAST(positive_score AS DECIMAL(9, 6)) * 0.50 + {points(("intent = 'praise'", "0.20"))}
             + {points(("intent = 'suggestion' AND positive_score > 0.4e0", "0.10"))}
             + CASE WHEN likes > 50 THEN 0.15 WHEN likes > 10 THEN 0.07 WHEN likes > 4 THEN 0.03
                    ELSE 0.00 END
             + {points(("length(text) > 100", "0.05"))}, 3) AS DOUBLE) AS positivity,
       CAST(round(CASE WHEN {praise} OR helps THEN 0.00 ELSE CAST(negative_score AS DECIMAL(9, 6)) * 0.45 END
             + {points(("blames AND NOT helps", "0.30"), ("intent = 'complaint' AND NOT helps", "0.15"),
                       (f"is_sarcastic AND negative_score > 0.3e0 AND NOT {praise}", "0.10"),
                       (f"likes > 20 AND negative_score > 0.5e0 AND NOT {praise}", "0.10"))}, 3) AS DOUBLE) AS criticism,
       CAST(round({points((f"asks AND NOT {rhetorical}", "0.50"), (f"intent = 'question' AND NOT {rhetorical}", "0.20"),
                     ("helps", "0.10"))}, 3) AS DOUBLE) AS curiosity
FROM (SELECT *, coalesce(like_count, 0) AS likes, {any_of("t", "HELP_REQUESTS")} AS helps,
             {any_of("t", "CRITICISM_MARKERS")} AS blames, {GENUINE_QUESTION} AS asks
      FROM {source}) a"""


def segment_step(source: str) -> str:
    happy = "(intent = 'praise' OR positive_score > 0.70e0 OR positivity > 0.60e0)"
    names = [pick([info[i] for info in SEGMENTS.values()], "segment") for i in range(3)]
    return f"""
SELECT *, {names[0]} AS segment_label, {names[1]} AS segment_color, {names[2]} AS segment_icon
FROM (SELECT *, CASE
        WHEN criticism > 0.35e0 AND criticism > positivity AND criticism > curiosity
             AND negative_score > 0.40e0 AND NOT {happy} AND NOT helps THEN 1
        WHEN positivity > 0.45e0 AND positivity > criticism AND positivity >= curiosity
             AND (likes >= 5 OR positive_score > 0.65e0) THEN 0
        WHEN curiosity > 0.35e0 AND curiosity > criticism AND negative_score < 0.55e0 THEN 2
        WHEN positivity > 0.38e0 AND positivity > criticism AND positive_score > 0.55e0 THEN 0
        ELSE 3 END AS segment
      FROM {source}) a"""


QUALITY = (
    "CAST(round(greatest(0.0, least(1.0, 0.30 * CAST(least(length(text), 200) * 0.005 AS DECIMAL(9, 6)) "
    "+ 0.30 * CAST(least(coalesce(like_count, 0), 50) * 0.02 AS DECIMAL(9, 6)) + 0.20 * CAST(positive_score AS DECIMAL(9, 6)) "
    "+ 0.10 * (1 - CAST(negative_score AS DECIMAL(9, 6))) + CASE WHEN is_toxic THEN -0.5 ELSE 0.0 END "
    "+ CASE WHEN intent IN ('question', 'suggestion') THEN 0.2 ELSE 0.0 END)), 3) AS DOUBLE)"
)
INTENT = first_of("t", INTENT_RULES, "'general'")

# Named steps, in order; every query is prefixed by the steps up to the one it names.
RAW_STEPS = [("comments", COMMENTS), ("scored", sentiment_step("comments"))]
FULL_STEPS = [
    ("comments", COMMENTS),
    ("parsed", PARSED),
    ("spoken", language_step("parsed", "working_text")),
    ("scored", sentiment_step("spoken")),
    ("felt", emotion_steps("scored", "low")),
    ("labelled", f"""
SELECT * REPLACE (coalesce(like_count, 0) AS like_count),
       {TOXIC_SCORE} AS toxic_score, {IS_TOXIC} AS is_toxic, {SARCASM_SCORE} AS sarcasm_score,
       {sarcastic("low", "working_text")} AS is_sarcastic,
       {first_of("low", INTENT_RULES, "'general'")} AS intent FROM felt"""),
    ("voted", vote_steps("labelled")),
    ("corrected", corrected_step("voted")),
    ("axes", axes_step("corrected")),
    ("segmented", segment_step("axes")),
    ("analysed", f"SELECT *, {QUALITY} AS quality_score FROM segmented"),
]


def chain(steps: Sequence[tuple[str, str]], body: str) -> str:
    named = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps)
    return f"WITH {named} {body}"


def raw(body: str, *more: tuple[str, str]) -> str:
    """Over the comments as they came."""
    return chain([RAW_STEPS[0], *more], body)


def scored(body: str, *more: tuple[str, str]) -> str:
    """Over the comments as they came, with sentiment and emotion groups."""
    return chain([*RAW_STEPS, *more], body)


def full(body: str, *more: tuple[str, str]) -> str:
    """Over the analysed comments."""
    return chain([*FULL_STEPS, *more], body)


VOTED = ("voted", vote_steps("scored"))
SEGMENT_INPUT = ("ready", f"SELECT *, irony_label = 'irony' AS is_sarcastic, {INTENT} AS intent FROM scored")
SPOKEN = ("spoken", language_step("comments", "text"))
NUMBERED = ("numbered", "SELECT *, (ord // 20) AS batch, ord % 20 AS item FROM (SELECT *, "
            "row_number() OVER (PARTITION BY video_id ORDER BY comment_id) - 1 AS ord FROM comments) o")

DOCUMENT_VIDEOS = "SELECT 'v' || doc_id AS video_id, lang AS title, source AS channel FROM documents"
LABELLED_VIDEOS = (
    "SELECT 'v' || doc_id AS video_id, 'labelled' AS title, 'quality' || quality AS channel FROM labels"
)


def url_of(d: str) -> str:
    vid = f"lpad(CAST({d} AS VARCHAR), 11, '0')"
    forms = [
        f"'https://youtu.be/' || {vid} || '?t=3'",
        f"'https://www.youtube.com/watch?list=PL1&v=' || {vid}",
        f"'https://www.youtube.com/shorts/' || {vid}",
        f"'https://www.youtube.com/live/' || {vid} || '?v=abcdefghijk'",
        f"'https://youtu.be/' || substring({vid}, 2, 10)",
        f"'https://www.youtube.com/embed/' || {vid} || 'tail'",
        "'not a url'",
    ]
    return f"list_extract([{', '.join(forms)}], CAST({d} % 7 AS INT) + 1)"


def video_id_of(url: str) -> str:
    patterns = [rf"youtu\.be/{VIDEO_ID}", rf"[?&]v={VIDEO_ID}", rf"/(?:shorts|embed|live|v)/{VIDEO_ID}"]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({url}, {lit(p)}, 1), '')" for p in patterns) + ")"


URLS = (
    f"(SELECT 'd' || doc_id AS row_id, {url_of('doc_id')} AS url FROM documents "
    "UNION ALL SELECT 'p' || page_id, url FROM pages) u"
)


def counts(column: str, domain: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{v}') AS {prefix}{v}" for v in domain)


APPROVAL = "round(100e0 * count(*) FILTER (WHERE sentiment = 'positive') / count(*), 1)"


def count_json(column: str, domain: Sequence[str]) -> str:
    parts = " || ',' || ".join(
        f"'\"{v}\":' || count(*) FILTER (WHERE {column} = '{v}')" for v in domain
    )
    return f"'{{' || {parts} || '}}'"


def segment_fields(seg: int) -> dict[str, str]:
    here = f"FILTER (WHERE segment = {seg})"
    best = f"arg_max(substring(text, 1, 120), likes::HUGEINT * 1000000000000 - comment_id) {here}"
    return {
        "count": f"count(*) {here}",
        "avg_likes": f"coalesce(round(avg(likes) {here}, 1), 0e0)",
        "top_comment": f"coalesce({best}, '')",
    }


SUMMARY = " UNION ALL ".join(
    f"SELECT video_id, {lit(name)} AS segment_label, {f['count']} AS count, {lit(color)} AS color, "
    f"{lit(icon)} AS icon, {lit(about)} AS description, {f['avg_likes']} AS avg_likes, "
    f"{f['top_comment']} AS top_comment FROM analysed GROUP BY video_id"
    for seg, (name, color, icon, about) in SEGMENTS.items()
    for f in [segment_fields(seg)]
)
FLAT_SUMMARY = ", ".join(
    f"{sql} AS seg{seg}_{field}" for seg in SEGMENTS for field, sql in segment_fields(seg).items()
)


def lexicon_step(source: str) -> str:
    p, n = count_of("low", "POSITIVE_TERMS"), count_of("low", "NEGATIVE_TERMS")
    return f"""
SELECT *, round(np / (np + nn + 1e0), 4) AS lp, round(nn / (np + nn + 1e0), 4) AS ln,
       round(1 / (np + nn + 1e0), 4) AS lu
FROM (SELECT *, {p} AS np, {n} AS nn FROM {source}) a"""


def argmax3(p: str, n: str, u: str) -> str:
    return (
        f"CASE WHEN {p} >= {n} AND {p} >= {u} THEN 'positive' WHEN {n} >= {u} THEN 'negative' "
        "ELSE 'neutral' END"
    )


def words_of(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
        f"lambda w: w NOT IN ({listed(lexicon.STOP_WORDS)}))"
    )


def term_steps(source: str, keys: str) -> list[tuple[str, str]]:
    """Unigrams and bigrams of ``text`` counted by keys."""
    return [
        ("worded", f"SELECT {keys}, {words_of('text')} AS ws FROM {source}"),
        ("terms", f"""
SELECT {keys}, term, count(*) AS tf FROM (
  SELECT {keys}, unnest(ws) AS term FROM worded
  UNION ALL
  SELECT {keys}, a || ' ' || b AS term FROM (
    SELECT {keys}, unnest(list_slice(ws, 1, len(ws) - 1)) AS a, unnest(list_slice(ws, 2, len(ws))) AS b
    FROM worded WHERE len(ws) > 1) z) e
GROUP BY {keys}, term"""),
    ]


GIVEN_TOPICS = ("topical", "SELECT video_id, comment_id, text, CAST(comment_id % 8 - 1 AS INT) AS topic FROM comments")
TOPIC_TERMS = [GIVEN_TOPICS, *term_steps("topical", "video_id, topic")]
TOPIC_LABELS = [
    *TOPIC_TERMS,
    ("kept", """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY video_id, term) AS nt,
                      sum(tf) OVER (PARTITION BY video_id, term) AS f FROM terms) a WHERE nt >= 2"""),
    ("means", """
SELECT video_id, avg(total) AS mean FROM (
  SELECT video_id, topic, sum(tf) AS total FROM kept GROUP BY video_id, topic) a GROUP BY video_id"""),
    ("best", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, topic ORDER BY score DESC, term) AS rk
  FROM (SELECT k.video_id, topic, term, round(tf * ln(1 + mean / f), 9) AS score
        FROM kept k JOIN means m ON k.video_id = m.video_id WHERE topic <> -1) a) b
WHERE rk <= 10"""),
    ("sizes", "SELECT video_id, topic, count(*) AS count FROM topical GROUP BY video_id, topic"),
    ("topic_list", """
SELECT b.video_id, b.topic, string_agg(term, ', ' ORDER BY rk) FILTER (WHERE rk <= 8) AS words,
       string_agg(term, ', ' ORDER BY rk) FILTER (WHERE rk <= 4) AS label, any_value(s.count) AS count
FROM best b JOIN sizes s ON b.video_id = s.video_id AND b.topic = s.topic
GROUP BY b.video_id, b.topic"""),
]

PREDICTIONS = [
    VOTED,
    ("mended", corrected_step("voted")),
    ("told", f"SELECT *, {INTENT} AS intent, {pick(INTENTS, 'comment_id % 5')} AS true_intent FROM mended"),
    ("predictions", """
SELECT 'emotion_single' AS task, g1 AS y, vote_keywords AS p FROM told
UNION ALL SELECT 'emotion_ensemble', g1, dominant_emotion FROM told
UNION ALL SELECT 'sentiment', scored_sentiment, sentiment FROM told
UNION ALL SELECT 'intent', true_intent, intent FROM told"""),
    ("rated", """
SELECT task, label, CAST(sum(s) AS BIGINT) AS support, sum(g) AS guessed, sum(r) AS hits FROM (
  SELECT task, y AS label, 1 AS s, 0 AS g, CASE WHEN y = p THEN 1 ELSE 0 END AS r FROM predictions
  UNION ALL SELECT task, p, 0, 1, 0 FROM predictions) a GROUP BY task, label"""),
    ("report", """
SELECT *, CASE WHEN pr + re = 0 THEN 0e0 ELSE 2e0 * pr * re / (pr + re) END AS f
FROM (SELECT *, CASE WHEN guessed = 0 THEN 0e0 ELSE CAST(hits AS DOUBLE) / guessed END AS pr,
             CASE WHEN support = 0 THEN 0e0 ELSE CAST(hits AS DOUBLE) / support END AS re FROM rated) a"""),
]
RATES = "round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1"
ACCURACY = (
    "SELECT task, round(avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS n "
    "FROM predictions GROUP BY task"
)

REPLY_STEPS = [
    NUMBERED,
    ("entries", f"""
SELECT video_id, batch, item, CASE WHEN comment_id % 13 = 0 THEN item + 100 ELSE item END AS id,
       CASE WHEN comment_id % 11 = 0 THEN 'neutral' ELSE {pick(EMOTIONS, "comment_id % 7")} END AS emotion,
       CASE WHEN comment_id % 17 = 0 THEN 'general' ELSE {pick(INTENTS, "comment_id % 5")} END AS intent
FROM numbered WHERE batch % 4 <> 3"""),
]

OVERRIDES = (
    "over_all", "SELECT doc_id * 2 AS comment_id, CASE WHEN toxic = 1 THEN 'disgust' WHEN quality = 1 "
    "THEN 'joy' ELSE 'oddlabel' END AS emotion FROM labels")
OVERRIDE_IF_CONFLICT = (
    "CASE WHEN v.conflict THEN coalesce(o.emotion, v.dominant_emotion) ELSE v.dominant_emotion END AS dominant_emotion"
)


def page(column: str) -> str:
    return f"row_number() OVER (PARTITION BY video_id ORDER BY {column} DESC, comment_id)"


def oracle() -> dict[str, str]:
    out: dict[str, str] = {}

    dump = chain(
        [RAW_STEPS[0]],
        """SELECT CAST(comment_id AS VARCHAR) AS comment_id, video_id,
                  (ord // 200) * 2147483648 + ord % 200 AS pos, CAST(parent_id AS VARCHAR) AS parent_id,
                  is_reply, text, coalesce(like_count, 0) AS like_count
           FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY comment_id) - 1 AS ord
                 FROM comments) o""",
    )
    out["s1_read_comment_dump"] = dump
    out["s1_read_comment_dump_videos"] = """
SELECT DISTINCT source AS video_id, 'About ' || source AS title, 'Unknown' AS channel, '' AS channel_id,
       0::BIGINT AS view_count, 0::BIGINT AS like_count, 0::BIGINT AS comment_count, 0::BIGINT AS duration,
       '' AS upload_date, '' AS description, '' AS thumbnail,
       'https://www.youtube.com/watch?v=AbCdEfGh_00' AS url FROM documents"""
    url = url_of("doc_id")
    out["s2_normalise_video_meta"] = f"""
SELECT CASE WHEN doc_id % 9 <> 8 THEN 'v' || doc_id ELSE '' END AS video_id,
       CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'Unknown' END AS title,
       CASE WHEN doc_id % 3 = 1 THEN lang WHEN doc_id % 4 <> 0 THEN source ELSE 'Unknown' END AS channel,
       CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS channel_id,
       CASE WHEN doc_id % 7 <> 0 THEN n_chars ELSE 0 END AS view_count,
       CASE WHEN doc_id % 6 <> 0 THEN doc_id ELSE 0 END AS like_count,
       0::BIGINT AS comment_count, doc_id % 600 AS duration,
       CASE WHEN doc_id % 2 = 1 THEN '20240131' ELSE '' END AS upload_date,
       CASE WHEN doc_id % 10 <> 0 THEN substring(text, 1, 500) ELSE '' END AS description,
       '' AS thumbnail, CASE WHEN doc_id % 3 <> 0 THEN lang || '|' || source ELSE '' END AS tags,
       coalesce('https://www.youtube.com/watch?v=' || {video_id_of(url)}, {url}) AS url
FROM documents"""
    out["s3_video_id_from_url"] = f"SELECT row_id, {video_id_of('url')} AS video_id FROM {URLS}"
    out["s4_canonical_url"] = (
        f"SELECT row_id, coalesce('https://www.youtube.com/watch?v=' || {video_id_of('url')}, url) "
        f"AS canonical FROM {URLS}"
    )
    out["s5_cap_comments"] = raw(
        "SELECT video_id, comment_id, like_count FROM (SELECT *, row_number() OVER (PARTITION BY video_id "
        "ORDER BY coalesce(like_count, 0) DESC, comment_id) AS rn FROM comments) r WHERE rn <= 200"
    )
    kept = f"SELECT * FROM ({DOCUMENT_VIDEOS}) o WHERE video_id NOT IN (SELECT video_id FROM ({LABELLED_VIDEOS}) n)"
    out["s6_upsert_videos"] = f"{LABELLED_VIDEOS} UNION ALL {kept}"
    out["s7_replace_video_comments"] = raw(
        "SELECT video_id, comment_id, parent_id, like_count FROM comments "
        "WHERE CAST(substring(video_id, 4) AS INT) >= 10 OR parent_id IS NOT NULL "
        "OR video_id NOT IN (SELECT video_id FROM comments WHERE parent_id IS NOT NULL)"
    )
    twice = (
        "SELECT video_id, comment_id, like_count FROM comments WHERE comment_id % 2 = 0 "
        "OR CAST(substring(video_id, 4) AS INT) % 3 <> 0 OR video_id NOT IN "
        "(SELECT video_id FROM comments WHERE comment_id % 2 = 0)"
    )
    out["s7_compacted_comments"] = raw(f"SELECT *, false AS stale FROM ({twice}) t")
    out["s9_stored_videos"] = raw(f"SELECT * FROM ({twice}) t WHERE video_id IN ('src1', 'src3', 'absent')")
    out["s9_stored_videos_of_channel"] = raw(
        f"SELECT * FROM ({twice}) t WHERE video_id IN (SELECT video_id FROM videos WHERE channel = 'channel0')",
        ("videos", VIDEOS),
    )
    out["s8_upsert_analyses"] = (
        f"SELECT *, '2024-05-01 12:00:00' AS created_at FROM ({LABELLED_VIDEOS}) n "
        f"UNION ALL SELECT *, '2024-01-01 00:00:00' FROM ({kept}) k"
    )
    out["s9_load_for_video"] = raw(
        "SELECT video_id, comment_id, like_count FROM comments WHERE video_id IN ('src1', 'src2', 'absent')"
    )
    out["s9_load_for_videos_of_channel"] = raw(
        "SELECT video_id, comment_id, like_count FROM comments "
        "WHERE video_id IN (SELECT video_id FROM videos WHERE channel = 'channel0')", ("videos", VIDEOS)
    )
    out["s10_skip_analysed"] = kept
    out["s10_already_analysed"] = (
        f"SELECT * FROM ({DOCUMENT_VIDEOS}) o WHERE video_id IN (SELECT video_id FROM ({LABELLED_VIDEOS}) n)"
    )
    out["s11_recent_analyses"] = (
        "SELECT 'e' || event_id AS video_id, event_type AS title, value AS approval_score, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events "
        "ORDER BY ts DESC, 'e' || event_id LIMIT 10"
    )
    out["s12_export_comments"] = full(
        "SELECT text, sentiment, dominant_emotion, intent, is_toxic, is_sarcastic, like_count, "
        "quality_score, segment_label, language FROM analysed"
    )

    out["c1_filter_empty"] = raw(f"SELECT comment_id, text FROM comments WHERE length({strip('text')}) > 3")
    out["c2_dedup_comments"] = raw(
        f"SELECT comment_id, video_id, text FROM (SELECT *, row_number() OVER (PARTITION BY video_id, "
        f"{strip('lower(text)')} ORDER BY comment_id) AS rn FROM comments WHERE {strip('text')} <> '') k WHERE rn = 1"
    )
    out["c3_clean_text"] = raw(f"SELECT comment_id, {cleaned('text')} AS clean_text FROM comments")
    out["c4_emoji_to_words"] = raw(f"SELECT comment_id, {emoji_words('text')} AS named FROM comments")
    called = pick(list(SEQUENCES.values()), f"doc_id % {len(SEQUENCES)}")
    out["c4_emoji_sequences"] = f"SELECT doc_id, lang || {called} || source AS named FROM documents"
    out["c5_parse_comments"] = raw("SELECT comment_id, video_id, text, clean_text FROM parsed", ("parsed", PARSED))
    out["c6_thread_split"] = raw(
        "SELECT comment_id, video_id, parent_id, CASE WHEN is_reply THEN 'reply' ELSE 'top' END AS side FROM comments"
    )
    out["c6_thread_split_conversations"] = (
        "SELECT conv_id, turn, CASE WHEN turn > 0 THEN 'reply' ELSE 'top' END AS side FROM conversations"
    )
    out["c7_reply_counts"] = raw(
        "SELECT c.comment_id, c.video_id, c.parent_id, coalesce(r.n, 0) AS reply_count FROM comments c "
        "LEFT JOIN (SELECT parent_id, count(*) AS n FROM comments WHERE parent_id IS NOT NULL GROUP BY parent_id) r "
        "ON c.comment_id = r.parent_id"
    )
    out["c8_has_emoji"] = raw(f"SELECT comment_id, regexp_matches(text, '{EMOJI}') AS has_emoji FROM comments")
    out["c9_working_text"] = raw(
        "SELECT comment_id, w AS working_text, substring(w, 1, 512) AS model_input FROM (SELECT comment_id, "
        f"coalesce(nullif({cleaned('text')}, ''), text) AS w FROM comments) a"
    )

    out["l1_hinglish_flag"] = raw(
        f"SELECT comment_id, {any_of('lower(text)', 'HINGLISH_MARKERS')} AS hinglish FROM comments"
    )
    out["l2_detect_language"] = raw("SELECT comment_id, language FROM spoken", SPOKEN)
    out["l2_language_facts"] = """
SELECT coalesce(lang, 'all') AS lang, count(*) AS held_out, true AS few_wrong, CASE WHEN lang IS NULL THEN true END AS accurate
FROM documents WHERE doc_id % 5 = 0 GROUP BY ROLLUP (lang)"""
    out["l3_route_three_way"] = raw(
        "SELECT comment_id, language, CASE WHEN language IN ('hinglish', 'en') THEN language ELSE 'other' END "
        "AS route FROM spoken", SPOKEN
    )
    multi = "language IN ('hinglish', 'hi', 'ur')"
    out["l4_route_two_way"] = raw(
        f"SELECT comment_id, language, {argmax3('p', 'n', 'u')} AS sentiment, p AS positive_score, "
        f"n AS negative_score FROM (SELECT *, CASE WHEN {multi} THEN lp ELSE positive_score END AS p, "
        f"CASE WHEN {multi} THEN ln ELSE negative_score END AS n, "
        f"CASE WHEN {multi} THEN lu ELSE neutral_score END AS u FROM counted) c",
        SPOKEN, ("counted", lexicon_step("spoken")),
    )
    out["l5_language_mix"] = raw(
        "SELECT video_id, hinglish, total, CASE WHEN hinglish < total * 0.2e0 THEN 'Mostly English' ELSE "
        "'Mixed English + Hinglish (' || hinglish || '/' || total || ' Hinglish)' END AS language_mix FROM "
        "(SELECT video_id, count(*) FILTER (WHERE language = 'hinglish') AS hinglish, count(*) AS total "
        "FROM spoken GROUP BY video_id) a", SPOKEN
    )
    out["l6_hinglish_count"] = raw(
        "SELECT video_id, count(*) FILTER (WHERE language IN ('hinglish', 'hi')) AS hinglish_count "
        "FROM spoken GROUP BY video_id", SPOKEN
    )

    out["n1_score_column"] = raw(
        f"""SELECT comment_id, {argmax3("p", "n", "u")} AS sentiment, p AS positive_score,
                   n AS negative_score, u AS neutral_score
            FROM (SELECT comment_id, round(e / (e + o + 1e0), 4) AS p, round(o / (e + o + 1e0), 4) AS n,
                         round(1 / (e + o + 1e0), 4) AS u
                  FROM (SELECT comment_id, length(x) - length(replace(x, 'e', '')) AS e,
                               length(x) - length(replace(x, 'o', '')) AS o
                        FROM (SELECT comment_id, text AS x FROM comments) a) b) c"""
    )
    out["n2_lexicon_sentiment"] = raw(
        f"SELECT comment_id, {argmax3('lp', 'ln', 'lu')} AS sentiment, lp AS positive_score, "
        "ln AS negative_score, lu AS neutral_score FROM counted",
        ("lowered", "SELECT comment_id, lower(text) AS low FROM comments"), ("counted", lexicon_step("lowered")),
    )
    scores = "positive_score, negative_score, neutral_score"
    out["n3_dominant_sentiment"] = scored(f"SELECT comment_id, sentiment, {scores} FROM scored")
    felt = ("felt", emotion_steps("scored", "t"))
    out["n4_group_emotions"] = scored(f"SELECT comment_id, {', '.join(EMOTIONS)} FROM felt", felt)
    out["n5_top_emotion"] = scored("SELECT comment_id, top_emotion, top_score, raw_top FROM felt", felt)
    out["n6_rule_emotion"] = scored(f"SELECT comment_id, {first_of('t', RULES, BY_SENTIMENT)} AS emotion FROM scored")
    out["n7_fix_praise_negation"] = scored(
        f"""SELECT comment_id, CASE WHEN e IN ('anger', 'sadness') AND NOT {any_of("t", "GENUINE_ANGER")}
                 AND ({any_of("t", "PRAISE_NEGATION")} OR (sentiment = 'positive' AND {any_of("t", "PRAISE_WORDS")}))
                 THEN 'joy' ELSE e END AS emotion
            FROM (SELECT *, {pick(EMOTIONS, "comment_id % 7")} AS e FROM scored) a"""
    )
    out["n8_label_emotions"] = scored(
        f"SELECT comment_id, emotion_model_rule, raw_top, {', '.join(EMOTIONS)} FROM felt", felt
    )
    out["n9_toxicity_label"] = raw(f"SELECT comment_id, {IS_TOXIC} AS is_toxic, {TOXIC_SCORE} AS toxic_score FROM comments")
    out["n11_sarcasm_label"] = raw(
        f"SELECT comment_id, {PLAIN_SARCASTIC} AS is_sarcastic, {SARCASM_SCORE} AS sarcasm_score FROM comments"
    )
    out["n12_sarcasm_override"] = raw(
        f"SELECT comment_id, {sarcastic('lower(text)', 'text')} AS is_sarcastic, {SARCASM_SCORE} AS sarcasm_score "
        "FROM comments"
    )
    out["n13_classify_intent"] = scored(f"SELECT comment_id, {INTENT} AS intent FROM scored")
    titles = [(name, label) for label, name in lexicon.TITLE_CATEGORIES.items()]
    out["n14_title_category"] = (
        f"SELECT doc_id, {first_of('low', titles, lit('General'))} AS category FROM (SELECT doc_id, "
        f"lower(CASE WHEN doc_id % 2 = 0 THEN {pick(TITLES, 'doc_id % 7')} ELSE text END) AS low FROM documents) d"
    )
    out["n15_merge_labels"] = raw(
        """SELECT c.comment_id, c.video_id, coalesce(c.like_count, 0) AS like_count,
                  CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
                  CASE l.quality WHEN 1 THEN 0.9e0 WHEN 0 THEN 0.1e0 ELSE 0e0 END AS positive_score,
                  0e0 AS negative_score, 1e0 AS neutral_score, 'neutral' AS dominant_emotion,
                  coalesce(l.toxic = 1, false) AS is_toxic,
                  CASE WHEN l.toxic = 1 THEN 0.9e0 ELSE 0e0 END AS toxic_score,
                  false AS is_sarcastic, 0e0 AS sarcasm_score
           FROM comments c LEFT JOIN labels l ON c.comment_id = l.doc_id * 2"""
    )

    out["e1_vote_model"] = scored("SELECT comment_id, vote_model AS vote FROM voted", VOTED)
    out["e2_vote_sentiment"] = scored(f"SELECT comment_id, {VOTE_SENTIMENT} AS vote FROM scored")
    out["e3_vote_keywords"] = scored(f"SELECT comment_id, {VOTE_KEYWORDS} AS vote FROM scored")
    cast = "vote_model, vote_sentiment, vote_keywords"
    out["e4_majority_vote"] = scored(f"SELECT comment_id, {cast}, dominant_emotion FROM voted", VOTED)
    out["e5_vote_conflicts"] = scored(f"SELECT comment_id, {cast} FROM voted WHERE conflict", VOTED)
    settled = f"SELECT v.comment_id, v.conflict, {OVERRIDE_IF_CONFLICT} FROM voted v LEFT JOIN over_all o ON v.comment_id = o.comment_id"
    out["e6_apply_tiebreaks"] = out["e7_ensemble_emotion"] = scored(settled, VOTED, OVERRIDES)
    mood = "CASE sentiment WHEN 'positive' THEN 'joy' WHEN 'negative' THEN 'anger' ELSE 'neutral' END"
    words = first_of("t", [(v, k) for k, v in lexicon.EVAL_EMOTIONS.items()], "'neutral'")
    out["e8_weighted_vote"] = scored(
        f"SELECT comment_id, g1 AS model, {first_valid(['g1', 'mood', 'words'], 'sentiment')} AS weighted_emotion "
        f"FROM (SELECT *, {mood} AS mood, {words} AS words FROM scored) a"
    )

    out["p1_pack_batches"] = raw(
        """SELECT video_id, batch, count(*) AS size,
                  CASE WHEN count(*) FILTER (WHERE lang = 'hinglish') < count(*) * 0.2e0 THEN 'Mostly English'
                       ELSE 'Mixed English + Hinglish (' || count(*) FILTER (WHERE lang = 'hinglish') || '/'
                            || count(*) || ' Hinglish)' END AS language_mix,
                  string_agg(item || '. [' || lang || '] "' || substring(text, 1, 200) || '"', chr(10)
                             ORDER BY item) AS lines
           FROM numbered GROUP BY video_id, batch""", NUMBERED
    )
    out["p1_pack_conflicts"] = scored(
        """SELECT video_id, batch, count(*) AS size,
                  string_agg(item || '. "' || substring(text, 1, 150) || '"', chr(10) ORDER BY item) AS lines
           FROM (SELECT *, (ord // 20) AS batch, ord % 20 AS item
                 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY comment_id) - 1 AS ord
                       FROM voted WHERE conflict) o) n
           GROUP BY video_id, batch""", VOTED
    )
    out["p2_parse_label_reply"] = raw("SELECT video_id, batch, id, emotion, intent FROM entries", *REPLY_STEPS)
    out["p3_apply_labels"] = raw(
        """SELECT n.comment_id, coalesce(e.emotion, 'neutral') AS dominant_emotion,
                  coalesce(e.intent, 'praise') AS intent
           FROM numbered n LEFT JOIN entries e
             ON n.video_id = e.video_id AND n.batch = e.batch AND n.item = e.id""", *REPLY_STEPS
    )
    videos = ("videos", VIDEOS)
    out["p4_report_facts"] = full(
        f"""SELECT a.video_id, any_value(v.title) AS title, any_value(v.channel) AS channel,
                   {APPROVAL} AS approval_score, {count_json("sentiment", SENTIMENTS)} AS sentiments,
                   {count_json("dominant_emotion", EMOTIONS)} AS emotions, {count_json("intent", INTENTS)} AS intents,
                   '' AS topics, count(*) FILTER (WHERE is_toxic) AS toxic_count, count(*) AS total
            FROM analysed a JOIN videos v ON a.video_id = v.video_id GROUP BY a.video_id""", videos
    )
    out["p5_content_gap_evidence"] = full(
        """SELECT video_id, count(*) AS total,
                  coalesce(string_agg('- ' || text, chr(10) ORDER BY comment_id)
                           FILTER (WHERE intent = 'question' AND rk <= 30), 'None found') AS questions,
                  coalesce(string_agg('- ' || text, chr(10) ORDER BY comment_id)
                           FILTER (WHERE intent = 'suggestion' AND rk <= 20), 'None found') AS suggestions
           FROM (SELECT *, row_number() OVER (PARTITION BY video_id, intent ORDER BY comment_id) AS rk
                 FROM analysed) r GROUP BY video_id"""
    )
    best = "SELECT video_id, string_agg(label, ', ' ORDER BY count DESC, topic) AS topics FROM (SELECT *, row_number() OVER " \
        "(PARTITION BY video_id ORDER BY count DESC, topic) AS rk FROM topic_list) t WHERE rk <= {} AND video_id IN " \
        "(SELECT video_id FROM topical GROUP BY video_id HAVING count(*) >= 10) GROUP BY video_id"
    out["p4_report_facts_topics"] = full(
        f"""SELECT a.video_id, any_value(v.title) AS title, coalesce(any_value(b.topics), '') AS topics, count(*) AS total
            FROM analysed a JOIN videos v ON a.video_id = v.video_id LEFT JOIN ({best.format(6)}) b ON b.video_id = a.video_id
            GROUP BY a.video_id""", videos, *TOPIC_LABELS
    )
    out["p5_content_gap_evidence_topics"] = full(
        f"""SELECT a.video_id, count(*) AS total, coalesce(any_value(b.topics), '') AS topics
            FROM analysed a LEFT JOIN ({best.format(8)}) b ON b.video_id = a.video_id GROUP BY a.video_id""", *TOPIC_LABELS
    )
    names = {"approval": APPROVAL, "toxic": "count(*) FILTER (WHERE is_toxic)"}
    names |= {s: f"count(*) FILTER (WHERE sentiment = '{s}')" for s in SENTIMENTS}
    names |= {f"emotion_{e}": f"count(*) FILTER (WHERE dominant_emotion = '{e}')" for e in EMOTIONS}
    sides = ", ".join(f"a.{n} AS {n}_a, b.{n} AS {n}_b, round(b.{n} - a.{n}, 1) AS {n}_delta" if n == "approval"
                      else f"a.{n} AS {n}_a, b.{n} AS {n}_b, b.{n} - a.{n} AS {n}_delta" for n in names)
    out["p6_compare_videos"] = full(
        f"SELECT a.video_id AS video_a, b.video_id AS video_b, a.title AS title_a, b.title AS title_b, {sides} "
        "FROM facts a JOIN facts b ON b.vn = a.vn + 1", videos,
        ("facts", "SELECT a.video_id, any_value(v.title) AS title, any_value(v.vn) AS vn, "
         + ", ".join(f"{sql} AS {n}" for n, sql in names.items())
         + " FROM analysed a JOIN videos v ON a.video_id = v.video_id GROUP BY a.video_id"),
    )

    out["g1_help_request"] = scored(f"SELECT comment_id, {any_of('t', 'HELP_REQUESTS')} AS help FROM scored")
    out["g2_genuine_question"] = scored(f"SELECT comment_id, {GENUINE_QUESTION} AS asks FROM scored")
    out["g3_correct_sentiment"] = scored(
        "SELECT comment_id, sentiment, positive_score, negative_score FROM mended", ("mended", corrected_step("scored"))
    )
    plain_axes = [SEGMENT_INPUT, ("axes", axes_step("ready"))]
    out["g4_axis_scores"] = scored("SELECT comment_id, positivity, criticism, curiosity FROM axes", *plain_axes)
    out["g5_assign_segment"] = scored(
        "SELECT comment_id, segment FROM segmented", *plain_axes, ("segmented", segment_step("axes"))
    )
    out["g6_segment_audience"] = scored(
        "SELECT comment_id, sentiment, segment, segment_label, segment_color, segment_icon FROM segmented",
        SEGMENT_INPUT, ("mended", corrected_step("ready")), ("axes", axes_step("mended")),
        ("segmented", segment_step("axes")),
    )
    out["g7_segment_summary"] = full(f"SELECT * FROM ({SUMMARY}) s")
    out["q1_quality_score"] = scored(
        f"SELECT comment_id, {QUALITY} AS quality_score FROM (SELECT *, {IS_TOXIC} AS is_toxic FROM ready) q",
        SEGMENT_INPUT,
    )

    flag = "CASE WHEN {} THEN 1e0 ELSE 0e0 END"
    out["v1_like_features"] = full(
        f"""SELECT a.comment_id, CAST(least(length(text), 500) AS DOUBLE) AS f_length,
                   positive_score AS f_positive, negative_score AS f_negative, neutral_score AS f_neutral,
                   {flag.format("intent = 'question'")} AS f_question, {flag.format("intent = 'praise'")} AS f_praise,
                   {flag.format("intent = 'complaint'")} AS f_complaint, {flag.format("is_sarcastic")} AS f_sarcastic,
                   {flag.format("is_toxic")} AS f_toxic, {flag.format(f"regexp_matches(text, '{EMOJI}')")} AS f_emoji,
                   CAST(least(coalesce(r.n, 0), 50) AS DOUBLE) AS f_replies
            FROM analysed a LEFT JOIN (SELECT parent_id AS pid, count(*) AS n FROM analysed
                                       WHERE parent_id IS NOT NULL GROUP BY parent_id) r ON a.comment_id = r.pid"""
    )
    out["v4_virality_score"] = raw(
        """SELECT comment_id, round(p / CASE WHEN m > 0 THEN m ELSE 1e0 END, 3) AS virality_score
           FROM (SELECT comment_id, p, max(p) OVER (PARTITION BY video_id) AS m
                 FROM (SELECT comment_id, video_id, ((comment_id * 7) % 50) / 10e0
                              - CAST(substring(video_id, 4) AS INT) % 3 * 5e0 AS p FROM comments) a) b"""
    )
    out["v5_no_model_default"] = raw(
        "SELECT comment_id, 0::BIGINT AS predicted_likes, 0e0 AS virality_score FROM comments"
    )

    out["n10_toxicity_held_out"] = """
SELECT count(*) AS held_out, count(*) FILTER (WHERE toxic = 1) AS toxic, true AS ranks_well
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 = 0"""
    out["v2_like_model_facts"] = full(
        "SELECT count(*) AS liked, 11 AS features, 1e0 AS importance, true AS none_negative, true AS better_than_mean "
        "FROM analysed WHERE like_count > 0"
    )
    out["v3_like_facts"] = full("SELECT video_id, count(*) AS comments, 1e0 AS best, 0::BIGINT AS negative FROM analysed GROUP BY video_id")
    out["v2_video_model_facts"] = full(
        "SELECT video_id, count(*) AS liked, 11 AS features, 1e0 AS importance, 0::BIGINT AS negative FROM analysed "
        "WHERE like_count > 0 GROUP BY video_id HAVING count(*) >= 15"
    )
    out["v3_video_like_facts"] = full(
        "SELECT video_id, count(*) AS comments, CASE WHEN count(*) FILTER (WHERE like_count > 0) >= 15 THEN 1e0 ELSE 0e0 END AS best, "
        "0::BIGINT AS negative FROM analysed GROUP BY video_id"
    )
    out["v6_like_model_kept"] = full("SELECT video_id, count(*) AS comments, count(*) AS same FROM analysed GROUP BY video_id")
    out["r17_report_topics"] = full(
        "SELECT a.video_id, any_value(v.title) AS title, count(*) AS total, true AS fits, true AS large, true AS by_size "
        "FROM analysed a JOIN videos v ON a.video_id = v.video_id GROUP BY a.video_id", videos
    )
    out["t1_topic_terms"] = raw("SELECT video_id, term, tf FROM terms", *term_steps("comments", "video_id"))
    out["t2_vocabulary"] = raw(
        "SELECT video_id, term, count(*) AS topic_frequency FROM terms GROUP BY video_id, term HAVING count(*) >= 2",
        *TOPIC_TERMS,
    )
    facts = "count(*) AS row_count, 0 AS small_topics, true AS numbered, true AS by_size"
    out["t3_topic_facts"] = raw(f"SELECT video_id, {facts} FROM parsed GROUP BY video_id", ("parsed", PARSED))
    out["t3_topic_facts_vectors"] = f"SELECT label, {facts} FROM embeddings GROUP BY label"
    out["t4_topic_labels"] = raw("SELECT video_id, topic, label, words, count FROM topic_list", *TOPIC_LABELS)
    out["t5_topic_sizes"] = raw(
        "SELECT video_id, topic, count(*) AS count FROM topical GROUP BY video_id, topic", GIVEN_TOPICS
    )
    out["t6_too_few_guard"] = """
SELECT conv_id AS video_id, conv_id * 1000 + turn AS comment_id,
       CAST(CASE WHEN n >= 10 THEN turn % 4 ELSE 0 END AS INT) AS topic, n >= 10 AS has_topics
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) c"""

    out["r1_approval_score"] = full(f"SELECT video_id, {APPROVAL} AS approval_score FROM analysed GROUP BY video_id")
    for key, column, domain in (
        ("r2_sentiment_counts", "sentiment", SENTIMENTS),
        ("r3_emotion_counts", "dominant_emotion", EMOTIONS),
        ("r4_intent_counts", "intent", INTENTS),
    ):
        out[key] = full(f"SELECT video_id, {counts(column, domain)} FROM analysed GROUP BY video_id")
    out["r5_flag_counts"] = full(
        "SELECT video_id, count(*) FILTER (WHERE is_toxic) AS toxic_count, "
        "count(*) FILTER (WHERE is_sarcastic) AS sarcasm_count FROM analysed GROUP BY video_id"
    )
    tests = {f"{s}_pct": f"sentiment = '{s}'" for s in SENTIMENTS}
    tests |= {"toxic_pct": "is_toxic", "sarcastic_pct": "is_sarcastic"}
    shares = ", ".join(f"round(100e0 * count(*) FILTER (WHERE {t}) / count(*), 1) AS {n}" for n, t in tests.items())
    out["r6_shares"] = full(f"SELECT video_id, {shares} FROM analysed GROUP BY video_id")
    out["r7_approval_band"] = full(
        "SELECT *, CASE WHEN approval_score < 40 THEN 'low' WHEN approval_score < 65 THEN 'mid' ELSE 'high' END AS band "
        f"FROM (SELECT video_id, {APPROVAL} AS approval_score FROM analysed GROUP BY video_id) a"
    )
    out["r8_intent_by_sentiment"] = full(
        "SELECT video_id, intent, sentiment, count(*) AS count FROM analysed GROUP BY video_id, intent, sentiment"
    )
    out["r9_top_comment_per_emotion"] = full(
        "SELECT video_id, dominant_emotion, comment_id, likes AS like_count, substring(text, 1, 200) AS text FROM "
        "(SELECT *, row_number() OVER (PARTITION BY video_id, dominant_emotion ORDER BY likes DESC, comment_id) AS rk "
        "FROM analysed) r WHERE rk = 1"
    )
    out["r10_top_comments_per_segment"] = full(
        "SELECT video_id, segment_label, comment_id, likes AS like_count, substring(text, 1, 200) AS text, sentiment, "
        "is_sarcastic, is_toxic, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_label "
        "ORDER BY likes DESC, comment_id) AS rk FROM analysed) r WHERE rk <= 5"
    )
    out["r11_filter_comments"] = full(
        "SELECT comment_id, sentiment, intent, segment_label FROM analysed "
        "WHERE sentiment = 'positive' AND segment_label = 'Super Fans'"
    )
    out["r12_sort_comments"] = full(
        "SELECT comment_id, quality_score FROM analysed ORDER BY quality_score DESC, comment_id"
    )
    out["r13_page_comments"] = full(
        "SELECT video_id, comment_id, like_count, sentiment, intent, segment_label, rank, matches FROM (SELECT *, "
        f"{page('like_count')} AS rank, count(*) OVER (PARTITION BY video_id) AS matches FROM analysed "
        "WHERE intent = 'question') r WHERE rank <= 30"
    )
    unions = " UNION ALL ".join(
        f"SELECT video_id, '{e}' AS emotion, {e} AS count, {i} AS place FROM c" for i, e in enumerate(EMOTIONS)
    )
    out["r14_top_emotions"] = full(
        "SELECT video_id, emotion, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id "
        f"ORDER BY count DESC, place) AS rank FROM ({unions}) u) r WHERE rank <= 5",
        ("c", f"SELECT video_id, {counts('dominant_emotion', EMOTIONS)} FROM analysed GROUP BY video_id"),
    )
    out["r15_topics_by_size"] = raw(
        "SELECT video_id, label, count FROM topic_list ORDER BY video_id, count, label", *TOPIC_LABELS
    )
    out["r16_likes_by_segment"] = full(
        "SELECT video_id, segment_label, count, avg_likes, round(100e0 * count / sum(count) OVER "
        f"(PARTITION BY video_id), 1) AS share_pct FROM ({SUMMARY}) s"
    )
    whole = (
        f"""SELECT a.video_id, any_value(v.title) AS title, any_value(v.channel) AS channel, count(*) AS total,
                   {APPROVAL} AS approval_score, count(*) FILTER (WHERE is_toxic) AS toxic_count,
                   count(*) FILTER (WHERE is_sarcastic) AS sarcasm_count, {counts("sentiment", SENTIMENTS)},
                   {counts("dominant_emotion", EMOTIONS, "emotion_")}, {counts("intent", INTENTS, "intent_")},
                   {FLAT_SUMMARY},
                   {{more}}
            FROM analysed a JOIN videos v ON a.video_id = v.video_id GROUP BY a.video_id"""
    )
    out["r17_video_report"] = full(whole.replace(",\n                   {more}", ""), videos)
    runs = "CASE WHEN CAST(substring(a.video_id, 4) AS INT) < 10 THEN 1 ELSE 2 END AS run, count(*) AS stored_comments"
    out["r17_incremental_run"] = full(whole.replace("{more}", runs), videos)

    spelled = ("pos", "NEG", "neu", "LABEL_0", "label_1", "Label_2", "Positive", "other")
    full_names = ("positive", "negative", "neutral", "negative", "neutral", "positive", "positive", "other")
    whens = " ".join(f"WHEN {lit(s)} THEN {lit(f)}" for s, f in zip(spelled, full_names))
    out["m1_normalise_label"] = raw(
        f"SELECT comment_id, CASE {pick(spelled, 'comment_id % 8')} {whens} END AS label FROM comments"
    )
    out["m2_accuracy"] = out["m7_write_metrics"] = scored(ACCURACY, *PREDICTIONS)
    out["m3_class_report"] = scored(
        f"SELECT label, support, {RATES} FROM report WHERE task = 'emotion_ensemble'", *PREDICTIONS
    )
    out["m3_class_report_by_task"] = scored(f"SELECT task, label, support, {RATES} FROM report", *PREDICTIONS)
    weighted = ", ".join(
        f"round(sum({c} * support) / sum(support), 6) AS {n}" for c, n in (("pr", "precision"), ("re", "recall"), ("f", "f1"))
    )
    out["m4_weighted_scores"] = scored(f"SELECT task, {weighted} FROM report GROUP BY task", *PREDICTIONS)
    single = "avg(CASE WHEN g1 = vote_keywords THEN 1e0 ELSE 0e0 END)"
    ensemble = "avg(CASE WHEN g1 = dominant_emotion THEN 1e0 ELSE 0e0 END)"
    out["m5_ensemble_gain"] = scored(
        f"SELECT round({single} * 100, 1) AS single, round({ensemble} * 100, 1) AS ensemble, "
        f"round(({ensemble} - {single}) * 100, 1) AS ensemble_gain, count(*) AS test_samples FROM voted", VOTED
    )
    out["m6_plain_decisions"] = raw(
        "SELECT comment_id, toxic_label = 'toxic' AS plain_toxic, irony_label = 'irony' AS plain_sarcastic, "
        f"{group_of('emo1')} AS plain_emotion FROM comments"
    )
    return out
