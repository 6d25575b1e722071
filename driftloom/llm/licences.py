"""Licence scans: passages against licence templates by Dice coefficient over word bigrams.

A text's lines, and its paragraphs of several lines, are normalised (lower case, runs of other than letters and digits as one space)
and read as sets of word bigrams. A passage of ``a`` bigrams can reach a coefficient of ``t`` with a template of ``b`` only if
``t / (2 - t) <= a / b <= (2 - t) / t``; templates outside these bounds, and passages outside the bounds of all templates, are
never compared. What remains is compared exactly: ``2 * common / (a + b) >= t``.

DataFrame functions only, one pass, no shuffle; the templates are a table of the caller's that becomes a literal.

Null and empty texts hold no licence; passages of one word have no bigram. Repeated rows are judged each. Other columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.let import let
from driftloom.llm.meeting import unused
from driftloom.operators.once import with_once

# Fixed texts: notices by which works name their licence.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: The least Dice coefficient, in tenths.
TENTHS = 9


def bigrams_of(text: str) -> list[str]:
    """A template's distinct word bigrams, in order."""
    found = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(found, found[1:])))


def words_of(passage: Column) -> Column:
    return F.filter(F.split(F.lower(passage), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def with_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, tenths: int = TENTHS, text: str = "text", column: str = "licences") -> DataFrame:
    """Add an array of (licence, common, size, template_size), one for each passage and template that match, by licence. A column of
    that name is replaced."""
    known = {name: grams for name, grams in ((n, bigrams_of(t)) for n, t in sorted(templates.items())) if grams}
    # t = tenths / 10: the bounds t / (2 - t) and (2 - t) / t in whole numbers.
    low, high = tenths, 20 - tenths
    least = min((-(-low * len(g) // high) for g in known.values()), default=1)
    most = max((high * len(g) // low for g in known.values()), default=0)

    def against(grams: Column) -> Column:
        size = F.size(grams)

        def one(name: str, own: list[str]) -> Column:
            inside = (size * high >= len(own) * low) & (size * low <= len(own) * high)
            literal = F.array(*map(F.lit, own))
            match = let(F.size(F.array_intersect(grams, literal)), lambda c: F.when(20 * c >= tenths * (size + len(own)), F.struct(F.lit(name).alias("licence"), c.alias("common"), size.alias("size"), F.lit(len(own)).alias("template_size"))))
            return F.when(inside, match)

        return F.filter(F.array(*(one(n, g) for n, g in known.items())), lambda m: m.isNotNull())

    t = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.split(t, r"\n[\x20\t\r]*\n"), lambda p: p.contains("\n"))
    passages = F.transform(F.concat(F.split(t, "\n"), paragraphs), words_of)
    # Distinct bigrams are no more than words less one; fewer words than the least template's bound can't hold enough.
    fitting = F.filter(passages, lambda w: (F.size(w) > least) & (F.size(w) > 1))
    grams = F.filter(F.transform(fitting, bigrams), lambda g: F.size(g).between(least, most))
    kept = [c for c in docs.columns if c != column]
    own = unused(docs.columns, "_grams")
    rows = with_once(docs.select(*kept), own, grams)
    found = F.array_sort(F.flatten(F.transform(own, against))) if known else F.array()
    return rows.select(*kept, found.alias(column))


def oracle_sql(templates: dict[str, str] = TEMPLATES, tenths: int = TENTHS) -> str:
    """DuckDB's form of the registered query, over ``documents``."""
    rows = ", ".join("('{}', {})".format(n, "['" + "', '".join(bigrams_of(t)) + "']") for n, t in templates.items())
    return f"""
WITH templates(licence, grams) AS (VALUES {rows}),
passages AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS passage FROM documents
  UNION ALL
  SELECT doc_id, passage FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) AS passage FROM documents) WHERE contains(passage, chr(10))
),
worded AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(passage), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM passages),
grams AS (SELECT doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM worded WHERE len(words) > 1),
matches AS (
  SELECT g.doc_id, t.licence, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM grams g JOIN templates t ON 20 * len(list_intersect(g.grams, t.grams)) >= {tenths} * (len(g.grams) + len(t.grams))
),
found AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, round(max(dice), 6) AS best_dice FROM matches GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences, coalesce(best_dice, 0.0) AS best_dice
FROM documents d LEFT JOIN found USING (doc_id)
"""
