"""Text as columns: tokens, phrases, kinds, tags, facts, likeness. Rules on a single query are plain functions below.

Patterns use Unicode word boundaries, as texts mix scripts; all columns stay inside the JVM but nfc().
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that make no phrase by themselves.
STOP = frozenset(
    """the a an is are was were be been being have has had do does did will would could should may might can shall it its this that these
    those and or but if then else when where how what which who whom whose there here not no nor so for of in on at to from by with as into
    through during before after above below between out off over under again further about up down very just also than too only own same
    such both each few more most other some all any every new""".split()
)
#: Tags and the words that give them.
TAGS = {
    "api": ["API", "REST", "GraphQL", "gRPC"],
    "database": ["DB", "database", "SQL", "PostgreSQL", "SQLite", "MySQL", "MongoDB"],
    "deploy": ["deploy", "배포", "CI/CD", "릴리즈", "release"],
    "test": ["test", "테스트", "검증", "QA", "unittest", "pytest"],
    "security": ["security", "보안", "auth", "인증", "취약점", "OWASP"],
    "performance": ["performance", "성능", "latency", "throughput", "최적화"],
    "bug": ["bug", "버그", "오류", "에러", "error", "fix", "수정"],
    "frontend": ["frontend", "프론트", "React", "Vue", "UI", "CSS", "HTML"],
    "backend": ["backend", "백엔드", "서버", "server", "FastAPI", "Django"],
    "infra": ["infra", "인프라", "Docker", "K8s", "Kubernetes", "AWS", "GCP"],
    "ai": ["AI", "ML", "LLM", "GPT", "Claude", "embedding", "벡터"],
    "docs": ["doc", "문서", "README", "documentation", "문서화"],
    "refactor": ["refactor", "리팩토링", "개선", "cleanup", "정리"],
    "design": ["design", "설계", "architecture", "아키텍처", "구조"],
    "monitoring": ["monitoring", "모니터링", "로그", "logging", "메트릭", "alert"],
}
#: Words that speak for a kind of node, the first kind winning ties.
KINDS = {
    "rule": "규정,정책,규칙,가이드라인,약관,법률,조항,기준,원칙,의무,금지,해야 한다,하여야 한다,불허,준수,regulation,policy,rule,guideline,terms,law,clause,standard,principle,must,shall,prohibited,mandatory,compliance,obligation,forbidden",
    "lesson": "교훈,장애,실패,사고,사례,경험,주의,오류,다음에는,배운 점,깨달은 점,회고,원인 분석,lesson,failure,incident,case study,experience,caution,error,postmortem,root cause,retrospective,takeaway,lessons learned,what went wrong",
    "decision": "결정,선택,채택,결론,판단,합의,대안,선택한 이유,의사결정,결재,decision,choice,adoption,conclusion,judgment,consensus,trade-off,tradeoff,decided,alternative,pros and cons,rationale",
    "entity": "회사,기관,조직,제품,서비스,인물,도시,국가,주식회사,법인,재단,company,organization,institution,product,service,person,city,country,Inc.,Corp.,Ltd.,LLC,GmbH,Co.",
    "artifact": "API,문서,보고서,코드,시스템,도구,프로토콜,스키마,엔드포인트,배포,릴리즈,document,report,code,system,tool,protocol,framework,library,endpoint,schema,/api/,v1,v2,repository,package,module,artifact,release",
}
#: Groups of words that mean the same.
SYNONYMS = [
    "버그 bug 오류 에러 error 결함 defect", "배포 deploy deployment 릴리즈 release", "성능 performance 퍼포먼스 속도 speed", "보안 security 취약점 vulnerability",
    "테스트 test testing 검증 verification", "리팩토링 refactor refactoring 개선 improvement", "설계 design 아키텍처 architecture", "문서 documentation docs 문서화",
    "의존성 dependency dependencies 패키지 package", "데이터베이스 database DB 디비", "인증 authentication auth 로그인 login", "권한 authorization permission 퍼미션",
    "API 엔드포인트 endpoint", "캐시 cache caching 캐싱", "로그 log logging 로깅", "모니터링 monitoring 관찰 observability", "자동화 automation 자동",
    "프론트엔드 frontend 프런트엔드 UI 화면", "백엔드 backend 서버 server", "작업 task 태스크 할일 todo", "프로젝트 project", "에이전트 agent 요원", "예산 budget 비용 cost",
    "스프린트 sprint 반복", "학습 learning 러닝 훈련 training", "메모리 memory 기억", "지식 knowledge 노하우 knowhow", "결정 decision 판단", "규칙 rule 정책 policy",
    "실패 failure fail", "성공 success succeed",
]
#: Sentences that state a fact hold a number with a unit, or four digits, as every written date does.
FACTS = [
    r"\d[\d,.]*\s*(%|만|억|원|달러|km|kg|GB|MB|TB|명|건|개|년|월|일|시간|분|초|percent|million|billion|thousand)",
    r"\b\d{4,}\b",
]
#: Korean particles at the end of a word.
PARTICLE = "(에서|부터|까지|으로|의|을|를|에|은|는|이|가|와)$"
#: Korean particles that normalisation takes off, the first that fits.
PARTICLES = "에서 부터 까지 으로 에게 에는 에도 에서는 에서도 으로서 으로써 이라 이며 이고 이나 이든 처럼 만큼 의 을 를 에 은 는 이 가 와 로 서 며 고 나".split()
#: Two Hangul characters at least stay before a particle at the end of a word.
WITH_PARTICLE = rf"([가-힣]{{2,}}?)(?:{'|'.join(PARTICLES)})(?=[^가-힣]|$)"
PROPER = [r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", r"\b[A-Z][a-z]{2,}\b"]
ABBREVIATION, QUOTED, COMPANY = r"\(([A-Z]{2,8})\)", r"[「『“‘]([ -~가-힣ㄱ-ㅣ·\-]+)[」』”’]", r"\((?:주|사|재|학|재단|사단)\)(\w+)"


def nfc(text: Column) -> Column:
    """Composed Unicode; Spark has no such function, so it is applied once at ingest."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) and not t.isascii() else t)

    return composed(text)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group))


def keyword_tokens(text: Column) -> Column:
    """Distinct runs of two or more Latin letters, lower case, or of Hangul, in order."""
    return F.array_distinct(F.transform(_all(text, "[A-Za-z가-힣]{2,}"), F.lower))


def english_phrases(title: Column, content: Column, most: int = 5) -> Column:
    """The first distinct phrases, lower case: title, runs of capitalised words, single ones, abbreviations, quoted and company names."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    found = F.concat(F.array(F.trim(F.coalesce(title, F.lit("")))), *[_all(text, p) for p in PROPER], _all(text, ABBREVIATION, 1), _all(text, QUOTED, 1), _all(text, COMPANY, 1))
    low = F.transform(found, lambda p: F.lower(F.trim(p)))
    telling = lambda p: (F.length(p) >= 2) & ~p.rlike("^[0-9]+$") & F.exists(F.split(p, r"\s+"), lambda w: ~w.isin(*STOP))
    return F.slice(F.array_distinct(F.filter(low, telling)), 1, most)


def korean_phrases(text: Column, stop: tuple[str, ...] = (), least: int = 2, longest: int = 10) -> Column:
    """Distinct Hangul words without their particle, and pairs of neighbouring ones."""
    bare = lambda w: F.when(F.length(F.regexp_replace(w, PARTICLE, "")) >= 2, F.regexp_replace(w, PARTICLE, "")).otherwise(w)
    fits = lambda w, most: F.length(w).between(least, most) & ~F.exists(F.split(w, " "), lambda x: x.isin(*stop) if stop else F.lit(False))
    single = F.filter(F.transform(_all(text, "[가-힣]{2,}"), bare), lambda w: fits(w, longest))
    pairs = F.transform(_all(text, r"[가-힣]{2,}\s+[가-힣]{2,}"), lambda p: F.concat_ws(" ", bare(F.regexp_substr(p, F.lit("^[가-힣]+"))), bare(F.regexp_substr(p, F.lit("[가-힣]+$")))))
    return F.array_distinct(F.concat(single, F.filter(pairs, lambda w: fits(w, longest + 5))))


def phrases(locale: str, title: Column, content: Column) -> Column:
    """By language: Korean rules for ko, both for multi, English ones else."""
    korean = korean_phrases(F.concat_ws("\n", title, content))
    english = english_phrases(title, content)
    return korean if locale == "ko" else F.array_distinct(F.concat(korean, english)) if locale == "multi" else english


def without_particles(text: Column) -> Column:
    """Korean words without their particles, for search; all else stays."""
    return F.regexp_replace(text, WITH_PARTICLE, "$1")


def query_without_particles(query: str) -> str:
    return re.sub(WITH_PARTICLE, r"\1", query)


def tags(text: Column) -> Column:
    """The tags whose words stand in the text as words, whatever their case."""
    hit = [F.when(text.rlike(rf"(?iuU)\b(?:{'|'.join(map(re.escape, words))})\b"), F.lit(tag)) for tag, words in TAGS.items()]
    return F.array_compact(F.array(*hit))


def kind_scores(title: Column, content: Column) -> dict[str, Column]:
    """Two for each word of a kind in the title, one for each in the content; both in lower case already."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    return {kind: add([F.contains(title, F.lit(w)).cast("int") * 2 + F.contains(content, F.lit(w)).cast("int") for w in dict.fromkeys(words.lower().split(","))]) for kind, words in KINDS.items()}


def classify_kind(title: Column, content: Column) -> Column:
    """Struct (kind, confidence): the kind of most words, concept where there are none. Both texts are lowered once for all words."""
    low = F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.lower(F.coalesce(content, F.lit(""))).alias("c"))
    scored = lambda x: F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(kind_scores(x["t"], x["c"]).items())])
    best = F.transform(F.array(low), lambda x: F.array_max(scored(x)))
    return F.transform(best, lambda b: F.struct(F.when(b["score"] > 0, b["kind"]).otherwise("concept").alias("kind"), F.least(F.lit(1.0), b["score"] / 6.0).alias("confidence")))[0]


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?。])\s+")


def facts(text: Column) -> Column:
    """Distinct sentences that state a number with a unit or a date."""
    return F.array_distinct(F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: (s != "") & s.rlike("(?iU)" + "|".join(f"(?:{p})" for p in FACTS))))


def compress(text: Column, query: str, least: float = 0.3, most: int = 5) -> Column:
    """The sentences that share enough words with the query, the first one preferred; the best ones where none does."""
    cut = r"[\s,;:!?()\[\]]+"
    asked = [t for t in dict.fromkeys(re.split(cut, query.lower())) if len(t) >= 2 and t not in STOP]
    parts = sentences(F.coalesce(text, F.lit("")))
    if not asked:
        return F.array_join(F.slice(parts, 1, most), " ")
    share = lambda s: F.size(F.array_intersect(F.split(F.lower(s), cut), F.array(*map(F.lit, asked)))) / float(len(asked))
    scored = F.transform(parts, lambda s, i: F.struct((-(share(s) + F.when(i == 0, 0.1).otherwise(0.0))).alias("r"), i.alias("i"), s.alias("s")))
    enough = F.filter(scored, lambda x: x["r"] <= -least)
    best = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    chosen = F.when(F.size(enough) > 0, F.slice(F.transform(enough, lambda x: x["s"]), 1, most)).otherwise(F.transform(best, lambda x: x["s"]))
    return F.array_join(chosen, " ")


def preview(title: Column, texts: Column, limit: int = 600) -> Column:
    """The title and the opening chunks, to limit characters."""
    opening = F.nullif(F.array_join(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), "\n"), F.lit(""))
    return F.trim(F.substring(F.concat_ws("\n", F.trim(F.coalesce(title, F.lit(""))), opening), 1, limit))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the words, each with two blanks before and one behind it."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


# Rules on one query; a query is a short string, so these run on the driver.


def expand_synonyms(query: str) -> list[str]:
    """The query with one word at a time replaced by another of its group."""
    words, out = query.lower().split(), []
    for i, word in enumerate(words):
        same = {s for group in SYNONYMS if word in (names := group.lower().split()) for s in names if s != word}
        out += [" ".join([*words[:i], s, *words[i + 1 :]]) for s in sorted(same)]
    return [q for q in dict.fromkeys(out) if q != query.lower()]


COMPARED = re.compile(r"비교|차이|다른\s*점|versus|vs\.?|compare|difference|differ", re.I)
SPAN = re.compile(r"(\d{4})년?\s*(?:부터|에서|from)\s*(\d{4})년?\s*(?:까지|to|까지의)?", re.I)


def decompose(query: str) -> list[str]:
    """The parts of a query that conjunctions join, without words of comparison; or its two years; else the query."""
    query = query.strip()
    if len(query) < 4:
        return [query] if query else []
    for joint in (r"(?:와|과|랑|이랑|하고)\s+|\s+(?:그리고|및|또는)\s+", r"(?i)\s+(?:and|or|versus)\s+|\s+vs\.?\s+"):
        parts = [p.strip() for p in re.split(joint, query) if len(p.strip()) >= 2]
        if len(parts) > 1:
            break
    if len(parts) < 2:
        years, topic = SPAN.search(query), SPAN.sub("", query).strip()
        return [f"{topic} {y}년" for y in years.groups()] if years and topic else [query]
    if COMPARED.search(query):
        parts = [p for x in parts if len(p := COMPARED.sub("", x).strip()) >= 2]
    return parts if len(parts) > 1 else [query]


def compared(query: str) -> list[str]:
    """The topics of a comparison, without closing words such as "of A and B the relation"."""
    ends = r"(의\s+관계|의\s+연관|에\s+대해|에\s+미치는|을\s+비교|를\s+비교)$"
    parts = [p for x in re.split(r"(?:과|와|및|그리고)\s+", query) if len(p := re.sub(ends, "", x).strip()) >= 2]
    return parts if len(parts) > 1 else [query]


def asks_for_all(query: str) -> bool:
    """Whether a query wants every match, not the best few."""
    q = query.lower().strip()
    return any(t in q for t in ("모두", "전체", "목록", "리스트", "list all", "전수", "every ", "all of the ", "all the ", "show me all")) or "모든" in q[:6]


#: Words that tell what a query is after.
INTENTS = {
    "past_failures": "실패,에러,오류,버그,장애,incident,fail,error,bug,crash,broke,broken,problem,issue,wrong,잘못",
    "similar_decisions": "결정,선택,판단,채택,decide,decision,choose,chose,선택지,대안,alternative,approach,어떻게,how to,should",
    "related_rules": "규칙,정책,규정,제약,금지,필수,rule,policy,constraint,must,should not,required,mandatory,forbidden,하면 안",
    "reasoning_chain": "결과,원인,왜,이유,교훈,배운,outcome,result,why,because,lesson,learned,led to,caused,이어,때문",
    "context_explore": "관련,주변,연관,비슷한,explore,related,around,context,neighborhood,연결,linked",
}


def suggest_intent(query: str) -> str:
    q = query.lower()
    counts = {name: sum(w in q for w in words.split(",")) for name, words in INTENTS.items()}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else "general"


def detect_locale(text: Column) -> Column:
    """ko, ja or en where half of the characters that are no blanks are of it, else multi.

    Runs are taken out, not single characters, and each count is taken once: the choice is made from an array of the counts.
    """
    count = lambda cls: F.length(text) - F.length(F.regexp_replace(text, f"[{cls}]+", ""))
    counts = F.array(F.length(text) - F.length(F.regexp_replace(text, r"(?U)\s+", "")), count("가-힣"), count("ぁ-ゟァ-ヿ"), count("A-Za-z"))

    def chosen(n: Column) -> Column:
        whole, most = F.length(text) - n[0], F.greatest(n[1], n[2], n[3])
        kind = F.when(n[1] == most, "ko").when(n[2] == most, "ja").otherwise("en")
        return F.when((whole > 0) & (most * 2 >= whole), kind).otherwise("multi")

    return F.transform(F.array(counts), chosen)[0]
