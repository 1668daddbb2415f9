"""Secret scanning, with a random forest that removes false positives; DataFrame functions only.

A pattern finds candidates and the text around them.  The forest looks at a
candidate's length, its transitions between kinds of characters, how much of it
a dictionary covers, whether it stands in a path, and at the neighbouring words.
It is trained from labelled findings: by default those of :func:`labelled_findings`,
made by rule from digests, or a table with the same columns.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

# Published formats of keys.
FORMATS = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[0-9A-Za-z+/=\s]*-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"gh[pousr]_[0-9A-Za-z]{36}",
    r"xox[abprs]-[0-9A-Za-z\-]{10,80}",
    r"eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}",
    r"sk-[0-9A-Za-z]{20,64}",
)
NAMES = "(?i:password|passwd|secret|token|api_key|apikey|access_key)"
ASSIGNED = rf"(?<={NAMES}[\"']?[ ]{{0,2}}[:=][ ]{{0,2}}[\"']?)[^\s\"'<>]{{8,200}}"
_RUN, _FORMAT = r"[0-9A-Za-z+/_\-]", f"(?:{'|'.join(FORMATS)})"
#: A run of 24 characters or more with its padding.  It begins where a run does or the last candidate ended, and ends
#: before a mark that a published format follows, so that neither a key's name nor what is glued before a key hides it.
BARE = rf"(?:\G|(?<!{_RUN}))(?={_RUN}{{24}})(?!{_RUN}{{0,23}}[+/_\-]{_FORMAT}){_RUN}{{24,}}?(?:(?=[+/_\-]{_FORMAT})|(?!{_RUN})(?:={{1,2}}(?![0-9A-Za-z+/_=\-\"']))?)"
CANDIDATE = "|".join([*FORMATS, ASSIGNED, BARE])
#: Stands in every text that holds a candidate, and is searched much faster.
HINT = rf"[0-9A-Za-z+/_\-]{{20}}|-----BEGIN |xox[abprs]-|eyJ[0-9A-Za-z_\-]{{8}}|{NAMES}[\"']?[ ]{{0,2}}[:=]"
#: Characters of text kept before and behind a candidate.
BEFORE, BEHIND = 60, 30

# Words that the dictionary feature knows.
DICTIONARY = (
    "about above access account action address admin after again agent always animal answer application archive array article author backup basic before below better between black blue board body book boolean border button "
    "cache central change channel child class clean client close cloud code color column command comment common company complete config connect content context control copy count country create current custom daily data date debug default delete "
    "description design detail device direct disable display document domain dummy dynamic element email empty enable engine entry error event example export extended factory false feature field file filter first folder force format forward frame function "
    "general global graph green group handler header height hello hidden history home host house image import index info input insert install integer internal interface item java kernel label language large last layer left level library light limit line link list local login long "
    "main manager master member memory menu message method middle model module month name network node normal number object offset online option order output owner package page parent parser password path pattern phone picture place placeholder player plugin point port position present "
    "primary print private process product profile program project property provider public query random range read record region register release remote remove rename report request reset resource response result return right root sample schema school script search second section secret select sender "
    "server service session setting shell short show simple single size small source special standard start state static status stop storage stream string style submit success summary support system table target task template test text theme thread time title token tool total track transfer tree true type "
    "under unique unit update upload user valid value vector version video view virtual visible water website white width window word work world write yellow your"
).split()
PLACEHOLDERS = "changeme|example|xxxx|your|dummy|sample|placeholder|insert|redacted|todo|test"
KEY_WORDS = "token|secret|passw|api_?key|access_?key|private|auth|credential|bearer|pwd"
OTHER_WORDS = "sha\\d*|commit|checksum|digest|uuid|guid|md5|integrity|etag|hash|revision|sprite|image|font|id"
VOWELS = "[aeiouyáéíóúàèêîôûäöü]"


def _cut(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and what lies between them: one piece more."""
    return F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)), F.split(text, CANDIDATE)


def _neighbours() -> Column:
    """before, secret, behind of each of ``found``, with ``between``."""
    # a long key name may be a candidate itself, and still is what stands before its value
    lead = lambda i: F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.get("between", i))
    return F.transform("found", lambda s, i: F.struct(F.right(lead(i), F.lit(BEFORE)).alias("before"), s.alias("secret"), F.left(F.get("between", i + 1), F.lit(BEHIND)).alias("behind")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, before, secret, behind for every candidate of every text."""
    text = F.col(text_col)
    found, between = _cut(text)
    rows = docs.where(text.rlike(HINT)).select(F.col(id_col).alias("doc_id"), found.alias("found"), between.alias("between"))
    return rows.where(F.size("found") > 0).select("doc_id", F.inline(_neighbours())).distinct()


def features(found: DataFrame) -> DataFrame:
    """found(before, secret, behind) -> + one column per feature."""
    s, before = F.col("secret"), F.lower(F.right("before", F.lit(40)))
    size = F.greatest(F.length("secret"), F.lit(1)).cast("double")

    def share(pattern: str, of: Column = s) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / size

    covered = 1 - F.length(F.regexp_replace(F.lower(s), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / size
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.select(
        "*",
        F.least(size, F.lit(200.0)).alias("f_length"),
        share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]").alias("f_transitions"),
        share("[0-9]").alias("f_digits"),
        share("[A-Z]").alias("f_upper"),
        share("[^0-9A-Za-z]").alias("f_marks"),
        share("(?i)" + VOWELS).alias("f_vowels"),
        share(r"(.)\1").alias("f_repeats"),
        (F.size(F.array_distinct(F.split(s, ""))) / size).alias("f_distinct"),
        covered.alias("f_dictionary"),
        flag(s.rlike("(?i)" + PLACEHOLDERS)).alias("f_placeholder"),
        share("/").alias("f_slashes"),
        flag(before.rlike(r"(?:https?:|www\.|[a-z0-9]/|\.\./|=\S*/)\S*$")).alias("f_in_path"),
        flag(F.col("behind").rlike(r"^\.[a-z]{2,4}\b|^/")).alias("f_path_goes_on"),
        flag(before.rlike(rf"(?:{KEY_WORDS})\w*[\"']?\s*[:=]?\s*[\"']?(?:bearer )?$")).alias("f_key_word"),
        flag(before.rlike(rf"\b(?:{OTHER_WORDS})\b\W*(?:\w+\W+)?$")).alias("f_other_word"),
        flag(before.rlike(r"[:=]\s*[\"']?$")).alias("f_assigned"),
        flag(s.rlike("^(?:" + "|".join(FORMATS) + ")")).alias("f_format"),
        flag(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$")).alias("f_hex"),
        flag(s.rlike("^[0-9]+$")).alias("f_number"),
    )


def _of_formats(sha: Column, alnum: Column, b64: Column) -> list[Column]:
    """A value in each of the formats that the others do not show."""
    part = lambda a, n: F.substring(F.concat(alnum, alnum, alnum), a, n)
    return [
        F.concat(F.lit("ASIA"), F.upper(part(3, 16))), F.concat(F.lit("AIza"), part(5, 35)), F.concat(F.lit("xoxb-"), F.regexp_replace(F.substring(sha, 1, 12), "[a-f]", "7"), F.lit("-"), part(2, 24)),
        F.concat(F.lit("eyJ"), part(1, 20), F.lit(".eyJ"), part(7, 40), F.lit("."), part(4, 43)), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, b64, F.lit("\n-----END RSA PRIVATE KEY-----")),
        F.lit("-----BEGIN PRIVATE KEY-----"),
    ]


def labelled_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """before, secret, behind, label: findings by rule, about half of them false, as :func:`candidates` cuts them from texts.

    A candidate that has nothing in common with the text's value is left out.
    """
    i = F.col("id")
    digest = spark.range(n).select("id", F.sha2(F.concat(F.lit("finding "), i.cast("string")), 256).alias("sha"), F.md5(F.concat(F.lit("other "), i.cast("string"))).alias("md5"))
    digest = digest.withColumn("b64", F.translate(F.base64(F.unhex("sha")), "\r\n", "")).withColumn("alnum", F.regexp_replace("b64", "[^0-9A-Za-z]", "q"))
    # written step by step, so that no plan holds the expressions of all steps within each other
    digest = materialise(digest.withColumn("words", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), F.pmod(F.xxhash64(i, k), F.lit(len(DICTIONARY))).cast("int") + 1))), "secret-digests")
    sha, md5, b64, alnum = map(F.col, ("sha", "md5", "b64", "alnum"))
    word = lambda k: F.col("words")[k - 1]
    pick = lambda k, *options: F.element_at(F.array(*map(lambda o: o if isinstance(o, Column) else F.lit(o), options)), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(options))).cast("int") + 1)
    key = pick(1, 'token = "', "token: ", "secret=", 'api_key = "', "password = '", "Authorization: Bearer ", "access_key=", 'apikey: "', "token=", "GITHUB_TOKEN=", "export SECRET_KEY=", "API_KEY: ", "PASSWORD=", "client_secret=")
    other = pick(2, "commit ", "sha256 ", "checksum: ", "md5=", "uuid ", 'integrity="', "etag: ", "revision ", "digest ")
    prose = F.concat_ws(" ", word(3), word(4), word(5), F.lit(""))
    true_value = pick(6, F.substring(sha, 1, 40), sha, b64, F.substring(alnum, 1, 32), F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), F.concat(F.lit("ghp_"), F.substring(F.concat(alnum, alnum), 1, 36)), F.concat(F.lit("sk-"), F.substring(alnum, 1, 40)), F.substring(md5, 1, 32), *_of_formats(sha, alnum, b64))
    sep = pick(7, "_", "-", "/", "")
    names = F.concat(word(8), sep, word(9), sep, word(10), sep, word(11), sep, word(12))
    false_value = pick(13, names, F.concat_ws("/", word(8), word(9), word(10), F.concat(word(11), F.lit("-"), word(12))), F.repeat(pick(14, "x", "a", "0", "="), 32), F.concat(F.lit("your-"), word(8), F.lit("-placeholder-"), word(9)), F.concat(word(8), word(9), word(10), word(11), word(12), word(15)), F.repeat(word(8), 5), F.rpad(F.conv(F.substring(md5, 1, 12), 16, 10), 26, "314159"))
    kind = F.pmod(i, F.lit(4))
    parts = materialise(
        digest.select(
            "id", "words", kind.alias("kind"), key.alias("key"), prose.alias("prose"),
            F.when(kind.isin(0, 1), true_value).when(kind == 2, pick(17, F.substring(sha, 1, 40), sha, md5, b64)).otherwise(false_value).alias("value"),
            F.when(kind == 2, other).otherwise(pick(16, "", "", "https://cdn.site.org/a/", key, "see ")).alias("false_lead"),
        ),
        "secret-parts",
    )
    # a published format tells by itself, so keys in one stand behind anything
    loose = F.col("value").rlike("^(?:" + "|".join(FORMATS) + ")") & (F.pmod(F.xxhash64(i, F.lit(21)), F.lit(2)) == 0)
    lead = F.when(~F.col("kind").isin(0, 1), F.col("false_lead")).when(loose, pick(22, "key=", "see ", "", "AWS_ID=", "my-", "/")).otherwise(F.col("key"))
    rows = materialise(
        parts.select(
            F.col("kind").isin(0, 1).cast("double").alias("label"), F.col("id").alias("doc_id"), F.concat("prose", lead).alias("before"), "value",
            F.concat(pick(18, '"', "", "'", " "), F.lit(" "), word(19), F.lit(" "), word(20)).alias("behind"),
        ),
        "secret-texts",
    )
    found = candidates(rows.select("doc_id", F.concat("before", "value", "behind").alias("text")))
    same = F.contains("secret", "value") | F.contains("value", "secret")
    return found.join(rows.select("doc_id", "label", "value"), "doc_id").where(same).select("before", "secret", "behind", "label")


def train(labelled: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7) -> PipelineModel:
    rows = materialise(features(labelled), "secret-findings")
    names = [c for c in rows.columns if c.startswith("f_")]
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    assembled = VectorAssembler(inputCols=names, outputCol="features")
    return PipelineModel([assembled, forest.fit(assembled.transform(rows))])


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, secret, before, behind, probability, is_secret: every candidate with the forest's verdict.

    Null, empty and blank texts have no candidates; a null id keeps its findings
    under a null id.  A candidate that stands twice in one text with the same
    neighbours is one row.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    model = train(labelled_findings(spark) if labelled is None else labelled)
    judged = model.transform(features(candidates(docs, id_col, text_col)))
    probability = vector_to_array("probability")[1]
    return judged.select("doc_id", "secret", "before", "behind", F.round(probability, 6).alias("probability"), (probability >= threshold).alias("is_secret"))


def redact(docs: DataFrame, mark: str = "<SECRET>", id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, with confirmed secrets replaced where they stand.

    A value that is confirmed in one place stays in another where it is not.
    Texts are known by themselves, not by ids, so null and repeated ids are
    treated like others; null and empty texts, and those without a candidate, pass
    as they are and are not shuffled.  Equal texts get equal marks.
    """
    model = train(labelled_findings(docs.sparkSession) if labelled is None else labelled)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found, between = _cut(F.col("text"))
    key = F.sha2(F.col("text"), 256).alias("key")
    each = rows.where(hinted).select(key, found.alias("found"), between.alias("between")).where(F.size("found") > 0)
    each = each.select("key", F.posexplode(_neighbours()).alias("pos", "f")).select("key", "pos", "f.*")
    sure = model.transform(features(each)).where(vector_to_array("probability")[1] >= threshold)
    # as many as one text holds
    marks = materialise(sure.groupBy("key").agg(F.collect_set("pos").alias("marks")), "secret-marks")
    held = rows.where(hinted).select("row", "text", key).join(marks, "key", "left")
    put = F.transform("found", lambda s, i: F.when(F.array_contains("marks", i), F.lit(mark)).otherwise(s))
    whole = F.array_join(F.flatten(F.zip_with("between", F.concat(put, F.array(F.lit(""))), lambda b, p: F.array(b, p))), "")
    clean = held.where("marks is not null").select("row", "marks", found.alias("found"), between.alias("between")).select("row", whole.alias("text"))
    every = clean.unionByName(held.where("marks is null").select("row", "text")).unionByName(rows.where(~hinted))
    return every.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
