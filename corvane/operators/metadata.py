"""Document metadata by evidence: topics, problem kinds, provenance, document type, title, image-only units."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The topic taxonomy; patterns ignore case, acronyms do not.
TOPICS = {
    "Thread Fundamentals": r"\bthread control block|\blight-?weight process|\bsingle[- ]threaded|\bthread (state|stack)s?\b|\beach thread has\b|\bthreads? (of a process )?share\b|\bper-thread\b",
    "Multithreading": r"\bmulti-?\s?thread(ing|ed)\b",
    "Concurrency": r"\bconcurren(t|cy)\b",
    "Parallelism": r"\bparallel(ism|ly|ize|ization)?\b|\bmulti-?\s?core\b|\bmultiprocessors?\b",
    "Pthreads": r"\bpthreads?\b|\bPOSIX threads?\b|\bpthread_\w+",
    "Thread Creation": r"\bpthread_create\b|\bthread creation\b|\bcreat(e|es|ing|ed) (a |new |multiple |two |the )?(child )?threads?\b",
    "Thread Join": r"\bpthread_join\b|\bthr_join\b|\bjoin(s|ed|ing)? (the |a |child |all )?threads?\b|\bthread join\b",
    "Thread Models": r"\bmany[- ]to[- ]one\b|\bone[- ]to[- ]one\b|\bmany[- ]to[- ]many\b|\btwo[- ]level model\b|\b(multi)?threading models?\b",
    "User-Level Threads": r"\buser[- ]level threads?\b|\buser threads?\b|\bgreen threads?\b|\buser[- ]level threading\b",
    "Kernel Threads": r"\bkernel[- ]level threads?\b|\bkernel threads?\b",
    "Thread Scheduling": r"\bthread scheduling\b|\bscheduler\b|\bcontext switch(es|ed|ing)?\b|\bpreempt(ed|ion|ive|s)?\b",
    "Race Conditions": r"\brace conditions?\b|\bdata races?\b",
    "Critical Sections": r"\bcritical[- ]sections?\b",
    "Mutual Exclusion": r"\bmutual(ly)? exclusi(on|ve)\b",
    "Locks": r"\b(un)?lock(s|ed|ing)?\b(?!-free)",
    "Mutex": r"\bmutex(es)?\b|\bpthread_mutex_\w+",
    "Spinlocks": r"\bspin[- ]?locks?\b|\bspin(ning|s)?\b|\bbusy[- ]wait(ing|s)?\b",
    "Test-and-Set": r"\btest[- ]and[- ]set\b|\bTestAndSet\b|\bxchg\b|\batomic exchange\b",
    "Compare-and-Swap": r"\bcompare[- ]and[- ](swap|exchange)\b|\bCompareAndSwap\b|\bcmpxchg\b",
    "Condition Variables": r"\bcondition variables?\b|\bpthread_cond_\w+|\bcond_(wait|signal|broadcast)\b",
    "Semaphores": r"\bsemaphores?\b|\bsem_(wait|post|init|t)\b",
    "Monitors": r"\bmonitors?\b",
    "Peterson's Solution": r"\bpeterson'?s?\b",
    "Barriers": r"\bbarriers?\b",
    "Producer-Consumer": r"\bproducers?\b|\bbounded[- ]buffer\b",
    "Readers-Writers": r"\breaders?[- /]*(and[- ])?writers?\b|\breader-writer\b|\brwlock\b",
    "Dining Philosophers": r"\bphilosoph",
    "Deadlock": r"\bdeadlock(s|ed)?\b|\bcircular wait\b|\bhold[- ]and[- ]wait\b|\bbanker'?s algorithm\b",
    "Starvation": r"\bstarv(e|es|ed|ation|ing)\b|\bbounded waiting\b",
    "Concurrency Bugs": r"\bconcurrency bugs?\b|\batomicity[- ]violation\b|\border[- ]violation\b|\bnon-?\s?deadlock bugs?\b|\batomicity bugs?\b",
}
ACRONYMS = {"Thread Fundamentals": r"\bTCB\b", "Compare-and-Swap": r"\bCAS\b", "Condition Variables": r"\bCVs?\b"}
# Kinds of problems; each needs all of its patterns.
PROBLEMS = {
    "True/False": [r"\[T/F\]|\bTrue\s*/\s*False\b|\bT/F\b"],
    "MCQs": [r"(?s)\(a\).*\(b\).*\(c\)", r"\bwhich of the following\b|\bAns\w*[:.]?\s*\(?[a-d]\)"],
    "Conceptual Questions": [r"\bexplain\b|\bdescribe\b|\bwhy\b|\(Yes/No\)|\byes/no\b|\bstate (one|the|two)\b|\bwhat is\b|\bjustify\b"],
    "Programming Problems": [r"\bwrite (the |a )?(code|pseudocode|program|function|solution)\b|\bstudents must use\b|\bsample (input|output)\b|\bimplement\b"],
    "Synchronization Problems": [r"\busing (only )?(locks|semaphores|condition variables|mutex(es)?)\b|\bsynchroniz(e|ation) (problem|primitive)s?\b|\bmust use only\b"],
    "Debugging Problems": [r"\bbug(s|gy)?\b|\bwhat (is|are|went) wrong\b|\bidentify the (bug|problem|error)\b|\bis (this|the (above|following)) (code|solution) correct\b|\bcan deadlock\b"],
}
# Evidence of provenance and of document types, in order of precedence.
FILE_NAME = r"^((?:FALL|WINTER|SUM(?:MER)?)SEM\d{4}-\d{2})_[A-Z]+_([A-Z]{3,5}\d{3}[A-Z]?)_\d+_([A-Z]+)_(\d{4}-\d{2}-\d{2})_.+$"
BOOK, BOOK_NAME, BOOK_AUTHOR = r"THREE\s+EASY\s+PIECES|ARPACI-DUSSEAU|WWW\.OSTEP\.ORG", "OSTEP (Operating Systems: Three Easy Pieces)", "ARPACI-DUSSEAU"
INSTITUTIONS = {"IIT Bombay": r"IIT\s*Bombay|Indian Institute of Technology,?\s*Bombay", "VIT": r"\bVIT\b|Vellore Institute of Technology"}
PERSON = r"(?:Prof(?:essor)?\.?[ \t]+|Dr\.?[ \t]+)?([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3})\s*[,(]?\s*(?:CSE|Dept\.?[^,]{0,40})?\s*,?\s*(?:%s)"
TYPE_BY_TEXT = [(r"\bpractice problems\b", "practice_problems"), (r"(^|\n)\s*lab\s*:", "lab"), (r"\bassignment\b", "assignment"), (r"\btutorial\b", "tutorial"), (r"\b(question paper|mid[- ]?term|end[- ]?sem(ester)? exam|final exam)\b", "question_paper"), (r"(^|\n)\s*lecture\s*\d+", "lecture")]
TYPE_BY_NAME = [(r"(^|[^a-z])lab([^a-z]|$)", "lab"), (r"lecture[-_ ]?\d+", "lecture"), (r"assignment", "assignment"), (r"tutorial", "tutorial"), (r"question[-_ ]?paper|exam|quiz", "question_paper"), (r"practice", "practice_problems")]
QA_TYPES = ("practice_problems", "question_paper", "assignment", "lab", "tutorial")


def topic_counts(text: Column, taxonomy: Mapping[str, str] = TOPICS, acronyms: Mapping[str, str] = ACRONYMS) -> Column:
    """map(topic -> matches) in taxonomy order, without zeros."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    each = [x for name, p in taxonomy.items() for x in (F.lit(name), count(f"(?i){p}") + (count(acronyms[name]) if name in acronyms else F.lit(0)))]
    return F.map_filter(F.create_map(*each), lambda _, n: n > 0)


def document_topics(counts: Column, tokens: Column, least: int = 3, per_thousand: float = 1.0) -> Column:
    return F.map_keys(F.map_filter(counts, lambda _, n: (n >= least) & (n * 1000 / F.greatest(tokens, F.lit(1)) >= per_thousand)))


def problem_types(text: Column, kinds: Mapping[str, list[str]] = PROBLEMS) -> Column:
    def has(patterns: list[str]) -> Column:
        test = F.lit(True)
        for p in patterns:
            test = test & text.rlike(f"(?i){p}")
        return test

    return F.array_compact(F.array(*[F.when(has(p), name) for name, p in kinds.items()]))


def classify(docs: DataFrame) -> DataFrame:
    """docs(document_id, filename, layout, first_text, raw_text, clean_text, master_text, code_chars, tokens) plus metadata.

    The first evidence that matches decides; ``metadata_evidence`` says which it was.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    field = lambda i: F.when(stem.rlike(FILE_NAME), F.regexp_extract(stem, FILE_NAME, i))
    seen = F.concat_ws("\n", "first_text", F.substring("raw_text", 1, 3000))
    book = F.col("raw_text").rlike(BOOK)
    source, professor = F.when(book, BOOK_NAME), F.lit(None).cast("string")
    earlier = book
    for name, p in INSTITUTIONS.items():
        own = seen.rlike(p) & ~earlier
        person = F.regexp_extract(seen, PERSON % p, 1)
        source, professor, earlier = source.when(own, name), F.when(own & (person != ""), person).otherwise(professor), earlier | own
    source = source.when(stem.rlike(FILE_NAME), "VIT").otherwise("unknown")
    module = F.coalesce(*[F.when(F.regexp_extract(c, p, 1) != "", F.concat(F.lit("Module "), F.regexp_extract(c, p, 1))) for c, p in ((stem, r"(?i)\bModule[-_ ]+(\d+)\b"), (F.col("first_text"), r"\bModule\s*[-:]?\s*(\d+)\s*:"))])
    books = F.filter(F.split(F.coalesce("master_text", F.lit("")), "\n"), lambda t: t.rlike("Silberschatz|Operating System Concepts|Galvin"))
    kind, why, head = None, None, F.substring("first_text", 1, 600)
    code = F.col("code_chars") / F.greatest(F.char_length("clean_text"), F.lit(1))
    rules = [(head.rlike(f"(?i){p}"), t, f"first page/slide text matches '{p}'") for p, t in TYPE_BY_TEXT] + [(stem.rlike(f"(?i){p}"), t, f"filename matches '{p}'") for p, t in TYPE_BY_NAME]
    rules += [(book, "textbook", "textbook chapter"), (F.col("layout") == "slides", "lecture", "slide deck"), (code >= 0.5, "programming_examples", "half of the text is code"), (field(3) == "TH", "notes", "theory-course handout in document form")]
    for test, t, reason in rules:
        kind, why = (F.when(test, t), F.when(test, F.lit(reason))) if kind is None else (kind.when(test, t), why.when(test, F.lit(reason)))
    out = docs.withColumns({
        "source": source, "professor": professor, "author": F.when(F.col("raw_text").rlike(BOOK_AUTHOR), "Arpaci-Dusseau"), "semester": field(1), "course_code": field(2), "lecture_date": field(4), "module": module,
        "derived_from": F.when(F.size(books) > 0, F.array_join(books, "; ")), "document_type": kind.otherwise("unknown"), "subtopic_scores": topic_counts(F.col("clean_text")),
        "metadata_evidence": F.map_filter(F.create_map(F.lit("document_type"), why.otherwise("no evidence"), F.lit("semester"), F.when(stem.rlike(FILE_NAME), "filename fields"), F.lit("source"), F.when(source != "unknown", "document text or filename")), lambda _, v: v.isNotNull()),
    })
    return out.withColumns({"subtopic": document_topics(F.col("subtopic_scores"), F.col("tokens")), "problem_types": F.when(F.col("document_type").isin(*QA_TYPES), problem_types(F.col("clean_text"))).otherwise(F.array().cast("array<string>"))})


def titles(headings: DataFrame) -> DataFrame:
    """headings(document_id, pos, level, text) -> the first heading of the highest level."""
    return headings.groupBy("document_id").agg(F.min_by("text", F.struct("level", "pos")).alias("title"))


def image_only_units(units: DataFrame, least: int = 15) -> DataFrame:
    """units(document_id, number, images, body_tokens) -> numbers of pages that are images; never the first."""
    own = units.where((F.col("images") > 0) & (F.col("body_tokens") < least) & (F.col("number") != 1))
    return own.groupBy("document_id").agg(F.array_sort(F.collect_list("number")).alias("image_only_units"))
