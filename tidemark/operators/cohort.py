"""Cohorts: code flags, priority tags, weighted comorbidity, episodes from transfer chains, funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cleaning import small_table


def flags_by_prefix(df: DataFrame, entity: Sequence[str], code: str, flags: Mapping[str, Sequence[str]],
                    version: str | None = None) -> DataFrame:
    """0/1 flags per entity: does any of its codes start with one of the flag's prefixes?

    With ``version`` the prefixes are written ``"10:S06"`` and apply to rows of that code version only.
    """
    def hit(prefixes):
        conds = []
        for p in prefixes:
            if version is None:
                conds.append(F.col(code).startswith(p))
            else:
                v, stem = p.split(":", 1)
                conds.append((F.col(version).cast("string") == v) & F.col(code).startswith(stem))
        return reduce(lambda a, b: a | b, conds)

    return df.groupBy(*entity).agg(*[F.max(F.when(hit(p), 1).otherwise(0)).alias(f) for f, p in flags.items()])


def any_flag(flags: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f) for f in flags]) > 0


def priority_tag(pairs: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """Tag of the first flag in the list that is set."""
    return F.coalesce(*[F.when(F.col(flag) == 1, F.lit(tag)) for flag, tag in pairs], F.lit(default))


def code_rules(rules: Mapping[str, Sequence[str]]) -> list[tuple[str, int, str, str, str]]:
    """Rules as rows (category, length, head, lo, hi). ``"410"`` is a prefix, ``"4254-4259"`` a closed prefix range.

    The head is the first character, so that codes meet few rules; a range over several heads gives a row for each.
    """
    out = []
    for category, items in rules.items():
        for item in items:
            lo, _, hi = item.partition("-")
            hi = hi or lo
            out += [(category, len(lo), chr(c), lo, hi) for c in range(ord(lo[0]), ord(hi[0]) + 1)]
    return out


def category_flags(df: DataFrame, entity: Sequence[str], code: str, rules: Mapping[str, Sequence[str]],
                   exclude: Sequence[str] = ()) -> DataFrame:
    """Comorbidity flags from code prefixes and ranges.

    The rule table is declared in code, so its size is fixed and it is broadcast: rows meet it where they are, on prefix
    length and first character, and the only shuffle is that of the partial maxima per entity.
    """
    table = code_rules(rules)
    rule_rows = small_table(df.sparkSession, table, "category string, _len int, _head string, lo string, hi string")
    allowed = F.col(code)
    for e in exclude:
        allowed = F.when(~F.col(code).startswith(e), allowed)
    lengths = sorted({row[1] for row in table})
    stems = df.select(*entity, allowed.alias("_code"), F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_len"))
    stems = stems.select(*entity, "_len", F.substring("_code", F.lit(1), F.col("_len")).alias("_stem"))
    stems = stems.withColumn("_head", F.when(F.length("_stem") == F.col("_len"), F.substring("_stem", 1, 1)))
    met = stems.join(F.broadcast(rule_rows), ["_len", "_head"], "left")
    hit = F.when(F.col("_stem").between(F.col("lo"), F.col("hi")), F.col("category"))
    return met.withColumn("_hit", hit).groupBy(*entity).agg(*[F.max(F.when(F.col("_hit") == c, 1).otherwise(0)).alias(c) for c in rules])


def weighted_score(weights: Mapping[str, int], hierarchies: Sequence[tuple[str, int, str, int]] = ()) -> Column:
    """Sum of weights where the members of a hierarchy (mild, weight, severe, weight) count by their maximum."""
    def part(flag, weight):
        return F.coalesce(F.col(flag), F.lit(0)) * weight

    terms = [part(f, w) for f, w in weights.items()]
    terms += [F.greatest(part(mild, wm), part(severe, ws)) for mild, wm, severe, ws in hierarchies]
    return reduce(lambda a, b: a + b, terms)


# Weights of the published comorbidity index.
COMORBIDITY_WEIGHTS = {
    "myocardial_infarct": 1, "congestive_heart_failure": 1, "peripheral_vascular_disease": 1, "cerebrovascular_disease": 1,
    "dementia": 1, "chronic_pulmonary_disease": 1, "rheumatic_disease": 1, "peptic_ulcer_disease": 1, "paraplegia": 2,
    "renal_disease": 2, "aids": 6,
}
COMORBIDITY_HIERARCHIES = (
    ("mild_liver_disease", 1, "severe_liver_disease", 3),
    ("diabetes_without_cc", 1, "diabetes_with_cc", 2),
    ("malignant_cancer", 2, "metastatic_solid_tumor", 6),
)

# ICD-9 code rules of a comorbidity index in a study variant, which differs in places from the published index (prefix or closed prefix range).
COMORBIDITY_ICD9 = {
    "myocardial_infarct": ["410", "412"],
    "congestive_heart_failure": ["428", "39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491",
                                 "40493", "4254-4259"],
    "peripheral_vascular_disease": ["440", "441", "0930", "4373", "4471", "5571", "5579", "V434", "4431-4439"],
    "cerebrovascular_disease": ["430-438", "36234"],
    "dementia": ["290", "2941", "3312"],
    "chronic_pulmonary_disease": ["490-505", "4168", "4169", "5064", "5081", "5088"],
    "rheumatic_disease": ["725", "4465", "7100-7104", "7140-7142", "7148"],
    "peptic_ulcer_disease": ["531-534"],
    "mild_liver_disease": ["570", "571", "0706", "0709", "5733", "5734", "5738", "5739", "V427", "07022", "07023", "07032",
                           "07033", "07044", "07054"],
    "diabetes_without_cc": ["2500-2503", "2508", "2509"],
    "diabetes_with_cc": ["2504-2507"],
    "paraplegia": ["342", "343", "3341", "3440-3446", "3449"],
    "renal_disease": ["582", "585", "586", "V56", "5880", "V420", "V451", "5830-5837", "40301", "40311", "40391", "40402",
                      "40403", "40412", "40413", "40492", "40493"],
    "malignant_cancer": ["140-172", "1740-1958", "200-208", "2386"],
    "severe_liver_disease": ["4560-4562", "5722-5728"],
    "metastatic_solid_tumor": ["196-199"],
    "aids": ["042-044"],
}

# ICD-10 code rules of a comorbidity index in a study variant, which differs in places from the published index (prefix or closed prefix range).
COMORBIDITY_ICD10 = {
    "myocardial_infarct": ["I21", "I22", "I252"],
    "congestive_heart_failure": ["I50", "I110", "I130", "I132"],
    "peripheral_vascular_disease": ["I70", "I71", "I731", "I738", "I739", "R02", "Z958", "Z959"],
    "cerebrovascular_disease": ["I60-I69", "G45", "G46"],
    "dementia": ["F00-F03", "G30", "G311", "F051"],
    "chronic_pulmonary_disease": ["J40-J47", "J60-J67", "J684", "J701", "I278", "I279"],
    "rheumatic_disease": ["M05", "M06", "M315", "M32-M34", "M351", "M353", "M360"],
    "peptic_ulcer_disease": ["K25-K28"],
    "mild_liver_disease": ["B18", "K702", "K703", "K713-K715", "K717", "K73", "K74", "K760", "K762-K764", "Z944"],
    "diabetes_without_cc": ["E109", "E119", "E139", "E149"],
    "diabetes_with_cc": ["E100-E108", "E110-E118", "E130-E138", "E140-E148"],
    "paraplegia": ["G81", "G82", "G830-G834", "G838", "G839"],
    "renal_disease": ["I12", "I13", "N032-N037", "N052-N057", "N18", "N19", "N25", "Z490-Z492", "Z940"],
    "malignant_cancer": ["C00-C76"],
    "severe_liver_disease": ["K704", "K72", "K766", "K767", "I850", "I859", "I864", "I982"],
    "metastatic_solid_tumor": ["C77-C79"],
    "aids": ["B20-B24"],
}


def comorbidity_score() -> Column:
    return weighted_score(COMORBIDITY_WEIGHTS, COMORBIDITY_HIERARCHIES)


def subject_history_flags(entities: DataFrame, admissions: DataFrame, codes: DataFrame, entity: str, subject: str,
                          admission: str, code: str, flags: Mapping[str, Sequence[str]], version: str | None = None) -> DataFrame:
    """Flags from all admissions of a subject, mapped to each of the subject's entities (absent history = 0).

    The codes are reduced to one row per admission before anything is joined to entities.
    """
    per_admission = flags_by_prefix(codes, [admission], code, flags, version)
    per_subject = (admissions.select(subject, admission).distinct().join(per_admission, admission)
                   .groupBy(subject).agg(*[F.max(f).alias(f) for f in flags]))
    joined = entities.select(entity, subject).join(per_subject, subject, "left")
    return joined.select(entity, subject, *[F.coalesce(f, F.lit(0)).alias(f) for f in flags])


def first_episode(transfers: DataFrame, entity: str, time: str, origin_is_unit: Column, target_is_unit: Column,
                  fallback_ends: DataFrame | None = None, ends: Sequence[str] = ()) -> DataFrame:
    """First stay in a unit from a chain of transfers: enters with the first row towards the unit, ends with the
    first later row that leaves it, else with the first known fallback end."""
    starts = transfers.groupBy(entity).agg(F.min(F.when(target_is_unit, F.col(time))).alias("start"))
    starts = starts.filter(F.col("start").isNotNull())
    leaving = transfers.filter(origin_is_unit).join(starts, entity).filter(F.col(time) > F.col("start"))
    out = starts.join(leaving.groupBy(entity).agg(F.min(time).alias("end")), entity, "left")
    if fallback_ends is not None:
        out = out.join(fallback_ends, entity, "left").withColumn("end", F.coalesce("end", *ends)).drop(*ends)
    return out.withColumn("los", F.col("end") - F.col("start"))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], entity: str) -> DataFrame:
    """Entities left after each inclusion step, in order, with the drop at each step.

    ``df`` has one row per entity; all steps are counted in one pass.
    """
    kept = F.lit(True)
    counts, names = [F.count("*").alias("_s0")], ["all"]
    for i, (name, cond) in enumerate(steps, start=1):
        kept = kept & F.coalesce(cond, F.lit(False))
        counts.append(F.count_if(kept).alias(f"_s{i}"))
        names.append(name)
    wide = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"_s{i}").alias("n"),
                              (F.col(f"_s{max(i - 1, 0)}") - F.col(f"_s{i}")).alias("dropped")) for i, n in enumerate(names)])
    return wide.select(F.inline(rows))
