"""Text intelligence over lines: entities, fields, findings, lexicons, similarity and error measures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.base import SPARK, Spark, operator
from quillspark.runtime import shared_folder

#: Patterns of clinical text. What the original looks around for is matched beside the groups here.
NUMBER = r"\d+(?:\.\d+)?"
DOSAGE = r"(?i)\b(?:\d+(?:\.\d+)?|\d+/\d+)\s*(?:mg|mcg|g|gm|ml|iu|IU|puffs?|drops?|sachets?|tsp|tbsp)\b"
SCHEDULE = r"(?i)\b(?:[012]\s*[-–—]\s*[012]\s*[-–—]\s*[012](?:\s*[-–—]\s*[012])?|BID|TID|TDS|QID|OD|SOS|PRN|STAT|HS|AC|PC|\d+\s*(?:tab|cap|tabs|caps)\s*[xX]\s*\d+)\b"
FREQUENCY = r"(?i)\b(?:[012]\s*[-–—]\s*[012]\s*[-–—]\s*[012](?:\s*[-–—]\s*[012])?|OD|BD|BID|TDS|TID|QID|QDS|Q\d{1,2}H|QHS|HS|SOS|PRN|STAT|once daily|twice daily|thrice daily|at night|at bedtime)\b"
DURATION = rf"(?i)(?:\bx|\bfor|×)\s*({NUMBER})\s*(days?|d|weeks?|wks?|w|months?|m)\b|\b({NUMBER})\s*(days?|weeks?|months?)\b"
TIMING = r"(?i)\b(after (?:meals?|food|breakfast|lunch|dinner)|before (?:meals?|food|breakfast|lunch|dinner)|empty stomach|with (?:meals?|food|milk|water)|at bedtime|AC|PC)\b"
STRENGTH = rf"(?i)\b({NUMBER})\s*(mg|mcg|g|gm|ml|iu|%)(?:[^a-z/]|$)"
ROUTE = r"(?i)\b(oral(?:ly)?|topical(?:ly)?|IV|IM|SC|sublingual|inhal(?:ed|ation))\b"
INSTRUCTION = r"(?i)\b(as directed|as needed(?: for [a-z]+)?|when required|if required|every \d+ (?:hours?|hrs?)|take (?:once|twice|thrice|three times) (?:a day|daily))\b"
CONCENTRATION = r"(?i)\(\s*(\d+(?:\.\d+)?\s*(?:mg)?\s*/\s*\d+(?:\.\d+)?\s*(?:ml)?)\s*\)"
FORM = r"(?i)^(?:(?:\(?\d{1,2}[.)]?|rx|r/)\s+)?(tab|cap|syp|inj|oint|gel|drops?|susp|cream|inh|sachet)[.:]?\s+"
NAME = r"([A-Z][A-Za-z-]*(?:\s+(?:[A-Z][a-z][A-Za-z-]*|[A-Za-z]+-[A-Za-z0-9]+|[A-Z][0-9]+)){0,2})"
LAB = rf"^([A-Za-z][A-Za-z0-9 ()/.,\x27-]{{1,40}}?)\s+([<>]?\s*{NUMBER})\s*([a-zA-Z%/µ^0-9.]+(?:/[a-zA-Z.]+)?)?\s+((?:[<>]\s*{NUMBER})|(?:{NUMBER}\s*[-–]\s*{NUMBER}))\s*$"
KEY = r"[A-Z][A-Za-z .\x27/()-]{1,30}?"
KEY_VALUE = rf"({KEY})\s*:\s*([^:]+?)\s*$"
VITALS = {
    "mrn": r"(?i)\b(?:MRN|ID|PATIENT\s*ID)[:\s#]*([A-Z0-9\-]+)\b",
    "dob": r"(?i)\b(?:DOB|BIRTH)[:\s]*(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})\b",
    "blood_pressure": r"(?i)\b(?:BP|BLOOD\s*PRESSURE)[:\s]*(\d{2,3}\s*\/\s*\d{2,3})\b",
    "heart_rate": r"(?i)\b(?:HR|PULSE)[:\s]*(\d{2,3})\s*(?:bpm)?\b",
    "oxygen_sat": r"(?i)\b(?:SPO2|SAT|O2\s*SAT)[:\s]*(\d{2,3}%?)\b",
    "respiratory_rate": r"(?i)\b(?:RR|RESP)[:\s]*(\d{1,2})\b",
    "temperature": r"(?i)\b(?:TEMP)[:\s]*(\d{2,3}(?:\.\d)?)\s*(?:[FC°])?\b",
    "dosage": r"(?i)\b(\d+(?:\.\d+)?\s*(?:mg|mcg|ml|g|units?|iu|meq))\b",
}
#: Units and abbreviations of clinical text.
UNITS = (
    "mg", "mcg", "g", "gm", "ml", "iu", "tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules", "drop", "drops", "puff", "puffs", "sachet", "sachets", "tsp", "tbsp",
    "ampoule", "vial", "mmHg", "bpm", "F", "C", "mg/dL", "g/dL", "K/uL", "mEq/L", "U/L", "ng/mL", "pg/mL", "mmol/L", "mm/hr",
)
ABBREVIATIONS = (
    "Rx", "Dx", "Hx", "Sx", "CC", "HPI", "PE", "O/E", "C/O", "K/C/O", "Adv", "Inv", "BP", "PR", "HR", "RR", "Temp", "SpO2", "SPO2", "CBC", "WBC", "RBC", "Hb", "PLT", "ESR", "CRP", "LFT", "SGOT", "SGPT",
    "KFT", "RFT", "BUN", "Cr", "FBS", "PPBS", "HbA1c", "CXR", "ECG", "USG", "CT", "MRI", "ECHO", "OD", "BD", "BID", "TID", "TDS", "QID", "SOS", "PRN", "STAT", "HS", "AC", "PC", "NPO",
)
#: Medicines and words of the clinic that are known unless others are given.
DRUGS = ("Paracetamol", "Amoxicillin", "Cetirizine", "Calcium D3", "Calpol", "Hexigel")
CLINICAL = ("Diagnosis", "Patient", "Review", "Haemoglobin", "Advice")
#: Two letters or more of any alphabet, hyphens between them.
WORD = r"\p{L}[\p{L}-]+"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def named(d: Spark, line: str, terms: tuple[str, ...], fold: bool) -> str:
    """Those of ``terms`` that stand in a line as whole words, in the order of the list."""
    tests = []
    for t in terms:
        pattern = ("(?i)" if fold else "") + r"\b" + re.escape(t).replace("\\ ", " ").replace("\\/", "/") + r"\b"
        tests.append(f"CASE WHEN position({quoted(t.lower() if fold else t)} IN {'lower(' + line + ')' if fold else line}) > 0 AND {d.matches(line, pattern)} THEN {quoted(t)} END")
    return f"concat_ws(',', {', '.join(tests)})"


@operator("notes", drugs=DRUGS, units=UNITS, abbreviations=ABBREVIATIONS)
def entity_extract(d: Spark, notes: str, drugs: tuple, units: tuple, abbreviations: tuple) -> str:
    """Drugs, units and abbreviations of each line in the order of their lists; dosages and frequencies, each once, in order of their text."""
    lists = ", ".join(f"{d.joined(d.distinct(d.each(d.extract_all('line', p), 'x', f'{f}(trim(x))')), ',')} AS {n}" for n, p, f in (("dosages", DOSAGE, "lower"), ("frequencies", SCHEDULE, "upper")))
    return f"SELECT page, line_number, {named(d, 'line', drugs, True)} AS drugs, {lists}, {named(d, 'line', units, True)} AS units, {named(d, 'line', abbreviations, False)} AS abbreviations FROM {notes}"


@operator("notes")
def vital_signs(d: Spark, notes: str) -> str:
    """All matches of each clinical pattern."""
    return f"SELECT page, line_number, {', '.join(f'{d.joined(d.extract_all(chr(108) + chr(105) + chr(110) + chr(101), p, 1), chr(124))} AS {n}' for n, p in VITALS.items())} FROM {notes}"


def medicines(d: Spark, notes: str) -> str:
    """What each line says of a medicine. An advice line counts from behind its label."""
    e = lambda p, g=0: d.extract("line", p, g)
    advice = r"(?i)^\s*(?:Adv|Advice|Apply|Local)\s*[:.\-]\s*(.+)$"
    return f"""
    SELECT page, line_number, line, {e(FORM, 1)} AS form, {d.extract('line', '(?:' + FORM + ')' + '(?-i:' + NAME + ')', 2)} AS drug,
           {d.extract(d.replace('line', CONCENTRATION, ' '), STRENGTH, 1)} AS strength, lower({d.extract(d.replace('line', CONCENTRATION, ' '), STRENGTH, 2)}) AS unit, upper({e(FREQUENCY)}) AS frequency,
           concat({e(DURATION, 1)}, {e(DURATION, 3)}) AS duration, lower(concat({e(DURATION, 2)}, {e(DURATION, 4)})) AS duration_unit, lower({e(TIMING, 1)}) AS timing,
           lower({e(ROUTE, 1)}) AS route, {d.replace(e(CONCENTRATION, 1), r'\s+', '')} AS concentration, lower({e(INSTRUCTION, 1)}) AS instructions,
           trim({d.replace(d.replace(d.extract('line', '(?:' + FORM + ')' + '(?-i:' + NAME + r')(?-i:((?:\s+[a-z]+)+))', 3), r'\b(?:for|x|after|before|with|at|take|as|every|once|twice|thrice|when|if|empty|oral|orally|topical|topically|sublingual|inhaled|inhalation)\b.*', ''), r'^(\s*[a-z]+\s*[a-z]*\s*[a-z]*).*$', '$1')}) AS preparation
    FROM (SELECT page, line_number, CASE WHEN {d.matches('line', advice)} THEN concat('Gel ', {d.extract('line', advice, 1)}) ELSE line END AS line FROM {notes})"""


@operator("notes")
def medication_lines(d: Spark, notes: str) -> str:
    """Form, drug (up to three words), strength, frequency, duration, timing, route, concentration, preparation and instructions
    of the lines that name a medicine."""
    columns = "drug, strength, unit, frequency, duration, duration_unit, timing, route, concentration, preparation, instructions"
    return f"SELECT page, line_number, form, {columns} FROM ({medicines(d, notes)}) WHERE form <> ''"


@operator("notes")
def dose_attach(d: Spark, notes: str) -> str:
    """Lines of nothing but a schedule fill what the last medicine above them leaves out."""
    over = "PARTITION BY page ORDER BY line_number ROWS UNBOUNDED PRECEDING"
    return f"""
    SELECT page, med AS line_number, max(drug) AS drug, coalesce(max(CASE WHEN form <> '' THEN nullif(frequency, '') END), min(nullif(frequency, ''))) AS frequency, count(*) - 1 AS follow_on
    FROM (SELECT *, {d.carried("CASE WHEN form <> '' THEN line_number END", over)} AS med FROM ({medicines(d, notes)}))
    WHERE med IS NOT NULL AND (form <> '' OR (form = '' AND frequency <> '' AND {d.matches('line', '^[0-9]')})) GROUP BY page, med"""


@operator("notes")
def lab_rows(d: Spark, notes: str) -> str:
    """Test, value, unit and range of result rows, flagged when outside the range, which may have one end only."""
    e = lambda g: d.extract("line", LAB, g)
    number = lambda x: f"try_cast({d.replace(x, '[<> ]', '')} AS DOUBLE)"
    end = lambda k: f"try_cast({d.extract('span', rf'({NUMBER})\s*[-–]\s*({NUMBER})', k)} AS DOUBLE)"
    return f"""
    SELECT page, line_number, test, v AS value, unit, low, high, CASE WHEN v < low THEN 'L' WHEN v > high THEN 'H' ELSE '' END AS flag
    FROM (SELECT page, line_number, test, v, unit, CASE WHEN span LIKE '>%' THEN {number('span')} ELSE {end(1)} END AS low, CASE WHEN span LIKE '<%' THEN {number('span')} ELSE {end(2)} END AS high
          FROM (SELECT page, line_number, {e(1)} AS test, {number(e(2))} AS v, {e(3)} AS unit, {e(4)} AS span FROM {notes}) WHERE test <> '')"""


@operator("notes")
def key_values(d: Spark, notes: str) -> str:
    """Keys and their whole values: a value ends before wide space and the next key, or with the line, and holds no colon."""
    parts = d.only(d.cut(d.replace("line", rf"\s{{2,}}({KEY}\s*:)", "\n$1"), "'\n'"), "p", d.matches("p", KEY_VALUE))
    told = lambda i: d.joined(d.each("parts", "p", f"trim({d.extract('p', KEY_VALUE, i)})"), "|")
    return f"SELECT page, line_number, {told(1)} AS keys, {told(2)} AS vals FROM (SELECT page, line_number, {parts} AS parts FROM {notes}) WHERE {d.size('parts')} > 0"


@operator("notes")
def checkbox_text(d: Spark, notes: str) -> str:
    """Glyph, state and label of check boxes."""
    p = r"^\s*(\[[ xX]?\]|\([ xX]?\))\s*(.*)$"
    return f"SELECT page, line_number, {d.extract('line', p, 1)} AS glyph, lower({d.extract('line', p, 1)}) LIKE '%x%' AS checked, {d.extract('line', p, 2)} AS label FROM {notes} WHERE {d.matches('line', p)}"


#: What a title within the first four lines makes of a page, in order.
TITLES = (
    ("discharge summary", "discharge_summary"), ("consent", "consent_form"), ("referral", "referral_form"), ("admission", "admission_form"), ("progress note", "clinical_note"), ("clinical note", "clinical_note"),
    ("biochemistry", "lab_report"), ("laboratory", "lab_report"), ("pathology", "lab_report"),
)


@operator("notes")
def document_types(d: Spark, notes: str) -> str:
    """What a page is: by its title, else by its medicines, results and fields."""
    titled = " ".join(f"WHEN position({quoted(k)} IN title) > 0 THEN {quoted(t)}" for k, t in TITLES)
    return f"""
    SELECT page, CASE {titled} WHEN meds > 0 AND (signs > 0 OR meds >= 2) THEN 'prescription' WHEN labs >= 2 THEN 'lab_report' WHEN fields >= 3 THEN 'form' ELSE '' END AS doc_type, meds, labs, fields
    FROM (SELECT page, coalesce({d.listagg("CASE WHEN line_number <= 4 THEN lower(line) END", " ", "line_number")}, '') AS title, count_if({d.matches('line', FORM)}) AS meds, count_if({d.matches('line', r'\bR[x×]\b|\bTab\b|\bCap\b')}) AS signs,
                 count_if({d.matches('line', LAB)}) AS labs, count_if({d.matches('line', KEY_VALUE)}) AS fields FROM {notes} GROUP BY page)"""


@operator("notes", drugs=DRUGS)
def validation_findings(d: Spark, notes: str, drugs: tuple) -> str:
    """What is doubtful about a medicine; a drug that isn't known may be near one that is."""
    known = ", ".join(f"({quoted(t)})" for t in drugs)
    return f"""
    WITH m AS (SELECT * FROM ({medicines(d, notes)}) WHERE form <> ''),
    near AS (SELECT drug, min(term) AS term FROM (SELECT drug, term, levenshtein(lower(drug), lower(term)) AS dist FROM (SELECT DISTINCT drug FROM m) CROSS JOIN (SELECT * FROM (VALUES {known}) v(term))) WHERE dist <= CASE WHEN length(term) <= 7 THEN 1 ELSE 2 END GROUP BY drug)
    SELECT page, line_number, concat_ws(',', CASE WHEN lower(form) IN ('tab', 'cap', 'sachet') AND unit = 'ml' THEN 'liquid_unit' END, CASE WHEN frequency LIKE '0-0-0%' THEN 'never_taken' END,
           CASE WHEN try_cast(duration AS DOUBLE) * CASE WHEN duration_unit LIKE 'w%' THEN 7 WHEN duration_unit LIKE 'm%' THEN 30 ELSE 1 END > 365 THEN 'too_long' END, CASE WHEN try_cast(duration AS DOUBLE) = 0 THEN 'no_time' END,
           CASE WHEN strength = '' THEN 'no_strength' END, CASE WHEN n.term IS NULL THEN 'unknown_drug' WHEN lower(n.term) <> lower(m.drug) THEN 'near_drug' END) AS findings, coalesce(n.term, '') AS drug
    FROM m LEFT JOIN near n ON n.drug = m.drug"""


@operator("notes")
def section_carry_forward(d: Spark, notes: str) -> str:
    """The heading that each line stands under."""
    return f"SELECT page, line_number, coalesce({d.carried('CASE WHEN ' + d.matches('line', '^[A-Z ]+:$') + ' THEN line END', 'PARTITION BY page ORDER BY line_number ROWS UNBOUNDED PRECEDING')}, 'TOP') AS section FROM {notes}"


#: Items of lists, rows with a label, and what ends a sentence.
LIST_ITEM = r"^(?:[-*•→>]|[0-9]{1,2}[.)]|[a-z][.)])\s+"
LABEL_ROW = r"^[A-Za-z][\p{L}\p{N}_ /()\x27.&-]{0,30}\s*:\s*\S"
TERMINAL = r"[.!?:;]$"


@operator("notes", "ordinary")
def reflowed_paragraphs(d: Spark, notes: str, ordinary: str) -> str:
    """Wrapped lines joined into paragraphs, and whether a blank line parts a paragraph from the one above.

    A line goes on from the one above if it begins in lower case, is no item of a list, no row with a label and holds no bar, and the one above
    neither ends a sentence nor stands alone (items of lists may go on). A hyphen at the end goes; a word broken without one is
    joined where its first part is no ``ordinary`` word and the whole is. Empty lines are left out. A line is judged as it was read, not with what
    it was joined to. All pairs of parts meet the lexicon once.
    """
    w = "OVER (PARTITION BY page ORDER BY line_number)"
    return f"""
    WITH l AS (SELECT page, line_number, line FROM (SELECT page, line_number, {d.replace("coalesce(line, '')", r'^' + chr(92) + 's+|' + chr(92) + 's+$', '')} AS line FROM {notes}) WHERE line <> ''),
    k AS (SELECT *, {d.matches('line', LIST_ITEM)} AS item, {d.matches('line', LABEL_ROW)} AS label, position(' | ' IN line) > 0 AS bar FROM l),
    p AS (SELECT *, lag(line) {w} AS above, lag(item) {w} AS item_above, lag(label OR bar) {w} AS alone_above FROM k),
    j AS (SELECT *, above IS NOT NULL AND NOT (item OR label OR bar) AND {d.matches('line', r'^' + chr(92) + 'p{Ll}')} AND NOT {d.matches("coalesce(above, '')", TERMINAL)} AND (item_above OR NOT alone_above) AS goes_on,
                 {d.matches("coalesce(above, '')", '-$')} AND NOT {d.matches("coalesce(above, '')", ' -$')} AS hyphen,
                 lower({d.extract("coalesce(above, '')", r'([^' + chr(92) + 's]+)$', 1)}) AS tail, lower({d.extract('line', r'^([^' + chr(92) + 's]+)', 1)}) AS head FROM p),
    c AS (SELECT DISTINCT tail, head FROM j WHERE goes_on AND NOT hyphen AND {d.matches('tail', '^' + chr(92) + 'p{L}+$')} AND {d.matches('head', '^' + chr(92) + 'p{L}+$')}),
    b AS (SELECT c.tail, c.head, true AS broken FROM c JOIN {ordinary} o ON o.term = concat(c.tail, c.head) WHERE NOT EXISTS (SELECT 1 FROM {ordinary} t WHERE t.term = c.tail)),
    g AS (SELECT j.page, j.line_number, j.line, j.item, j.label, j.bar, j.goes_on, CASE WHEN NOT j.goes_on OR j.hyphen OR coalesce(b.broken, false) THEN '' ELSE ' ' END AS apart, j.goes_on AND j.hyphen AS cut
          FROM j LEFT JOIN b ON j.goes_on AND b.tail = j.tail AND b.head = j.head),
    n AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) {w} AS par, coalesce(lead(cut) {w}, false) AS cut_below FROM g),
    q AS (SELECT page, par, {d.listagg("concat(apart, CASE WHEN cut_below THEN substring(line, 1, length(line) - 1) ELSE line END)", '', 'line_number')} AS body, count(*) AS lines,
                 bool_or(NOT goes_on AND (item OR label OR bar)) AS alone, bool_or(NOT goes_on AND (item OR label)) AS marked FROM n GROUP BY page, par)
    SELECT page, CAST(par AS BIGINT) AS paragraph, body, lines, coalesce(alone <> lag(marked) OVER (PARTITION BY page ORDER BY par), false) AS parted FROM q"""


@operator("notes")
def rendered_lines(d: Spark, notes: str) -> str:
    return f"SELECT page, line_number, concat_ws(' | ', concat_ws(' ', nullif(form, ''), nullif(drug, '')), nullif(concat(strength, ' ', unit), ' '), nullif(frequency, ''), nullif(timing, '')) AS rendered FROM ({medicines(d, notes)}) WHERE form <> ''"


@operator("notes")
def table_cells(d: Spark, notes: str) -> str:
    """Cells of a row, parted by a bar or three spaces or more; empty ones left out."""
    parts = "split(line, r'\\||\\s{3,}')" if d.name == "spark" else r"regexp_split_to_array(line, '\||\s{3,}')"
    return f"SELECT page, line_number, {d.joined(d.only(d.each(parts, 'c', 'trim(c)'), 'c', 'c <> ' + repr('')), '|')} AS cells FROM {notes}"


@operator("notes")
def agreeing_dose(d: Spark, notes: str) -> str:
    """A dose that two readings of a line agree on, the second with letters for digits."""
    fixed = d.replace("line", r"([0-9])[oO]", "$1" + "0" if d.name == "duck" else "$1" + "0")
    return f"SELECT page, line_number, {d.extract('line', STRENGTH, 1)} AS dose FROM {notes} WHERE {d.extract('line', STRENGTH, 1)} <> '' AND {d.extract('line', STRENGTH, 1)} = {d.extract(fixed, STRENGTH, 1)}"


@operator("lines")
def repaired_urls(d: Spark, lines: str) -> str:
    """Split addresses and paths put together."""
    x = d.replace("line", r"(https?)\s*:\s*/\s*/", "$1://")
    x = d.replace(x, r"([a-zA-Z0-9_-])\s*/\s*([a-zA-Z0-9_-])", "$1/$2")
    return f"SELECT doc_id, line_number, md5({d.replace(x, r'([a-zA-Z0-9_-])\s*[.]\s*([a-zA-Z0-9_-])', '$1.$2')}) AS fixed FROM {lines}"


@operator("lines")
def normalised_labels(d: Spark, lines: str) -> str:
    """Dashes, quotes and white space made plain."""
    return f"SELECT doc_id, line_number, md5(trim({d.replace('translate(line, ' + repr('–—−‘’“”') + ', ' + repr('---') + ')', r'[ \t]+', ' ')})) AS label FROM {lines}"


@operator("lines")
def file_names(d: Spark, lines: str) -> str:
    """Each line as a safe file name."""
    return f"SELECT doc_id, line_number, left({d.replace('line', '[^A-Za-z0-9._-]+', '_')}, 80) AS name FROM {lines}"


#: Phrases that a reader makes up.
BLACKLIST = (
    "what links here", "related changes", "upload file", "special pages", "permanent link", "page information", "cite this page", "wikidata item", "wikipedia", "wikimedia",
    "in the united states in the united states", "of the united states of the united", "the first time of the first time", "management anniversary", "cosmopolitanism formal holidays",
    "washington post", "new york times", "external links", "references categories",
)


@operator("lines", width="CAST(500 + line_number % 5 * 500 AS DOUBLE)")
def hallucination_flags(d: Spark, lines: str, width: str) -> str:
    """Made-up phrases, alphabet loops, lines too long for the ``width`` of their box (0: unknown) and symbol bursts."""
    phrases = "|".join(BLACKLIST)
    return f"""
    SELECT doc_id, line_number, CASE WHEN trim(line) = '' THEN 'empty' WHEN {d.matches('lower(line)', phrases)} THEN 'blacklisted' WHEN {d.matches('lower(line)', r'(?:[a-z]\s+){4,}[a-z]')} THEN 'alphabet_loop'
           WHEN {width} > 0 AND length(trim(line)) > {width} / 4.2 + 12 THEN 'too_long' WHEN length(trim(line)) > 8 AND {d.matches('trim(line)', r'^[\s.\x27\x22,\-_:;0-9()/\\]{5,}$')} THEN 'symbol_burst' ELSE 'passed' END AS verdict FROM {lines}"""


@operator("lines")
def repeated_phrases(d: Spark, lines: str) -> str:
    """Lines where two to four words come twice in a row, by comparing slices."""
    def test(n: int) -> str:
        words = ("slice(w, i, {n}) = slice(w, i + {n}, {n})" if d.name == "spark" else "w[i:i + {n} - 1] = w[i + {n}:i + 2 * {n} - 1]").format(n=n)
        return f"{d.size(d.only(d.span('1', f'{d.size(chr(119))} - {2 * n - 1}'), 'i', words))} > 0"

    cut = d.cut(f"lower(trim({d.replace('line', r'[ \t]+', ' ')}))", "' '")
    return f"SELECT doc_id, line_number, CASE {' '.join(f'WHEN {test(n)} THEN {n}' for n in (2, 3, 4))} ELSE 0 END AS loop_words FROM (SELECT doc_id, line_number, {cut} AS w FROM {lines})"


@operator("lines")
def error_flags(d: Spark, lines: str) -> str:
    """Failure modes of a reading and the worst severity among them."""
    return f"""
    SELECT doc_id, line_number, concat_ws(',', CASE WHEN conf < 60 THEN 'LOW_CONFIDENCE' END, CASE WHEN digits THEN 'DIGIT_LETTER_CONFUSION' END, CASE WHEN glyphs THEN 'UNRECOGNIZED_GLYPHS' END) AS flags,
           CASE greatest(CASE WHEN conf < 40 THEN 3 WHEN conf < 60 THEN 2 ELSE 0 END, CASE WHEN digits THEN 2 ELSE 0 END, CASE WHEN glyphs THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS severity
    FROM (SELECT doc_id, line_number, (doc_id * 31 + line_number * 7) % 100 AS conf, {d.matches('line', r'\b[0-9]*[lIOo][0-9]+\b')} AS digits, {d.matches('line', r'[?*#$%&]{2,}')} AS glyphs FROM {lines})"""


def _tokens(d: Spark, table: str, columns: str) -> str:
    return f"SELECT {columns}, token FROM (SELECT {columns}, {d.extract_all('text', WORD)} AS words FROM {table}) x {d.rows('words', 'y', 'token')}"


@operator("documents")
def token_frequency_lexicon(d: Spark, documents: str) -> str:
    """Words seen five times or more, with their canonical spelling: a capitalised one if there is one, then the commonest."""
    return f"""
    SELECT term, CAST(sum(n) AS BIGINT) AS n, min_by(token, rank) AS canonical FROM (
      SELECT lower(token) AS term, token, n, row_number() OVER (PARTITION BY lower(token) ORDER BY CASE WHEN {d.matches('token', '^[A-Z][a-z]')} THEN 0 ELSE 1 END, n DESC, token) AS rank
      FROM (SELECT token, count(*) AS n FROM ({_tokens(d, documents, 'doc_id')}) GROUP BY token)) GROUP BY term HAVING sum(n) >= 5"""


def _lexicon(d: Spark, documents: str, least: int) -> str:
    return f"SELECT lower(token) AS term, count(*) AS n FROM ({_tokens(d, documents, 'doc_id')}) GROUP BY lower(token) HAVING count(*) >= {least}"


@operator("documents")
def word_validity(d: Spark, documents: str) -> str:
    """The share of a document's words that the lexicon knows. Words are counted by document before they meet it."""
    own = f"SELECT doc_id, lower(token) AS w, count(*) AS n FROM ({_tokens(d, documents, 'doc_id')}) GROUP BY doc_id, lower(token)"
    return f"""
    WITH c AS ({own}), l AS (SELECT w AS term FROM c GROUP BY w HAVING sum(n) >= 8)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, round(CAST(sum(CASE WHEN term IS NULL THEN 0 ELSE n END) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS validity FROM c LEFT JOIN l ON c.w = l.term GROUP BY doc_id"""


@operator("documents")
def word_rarity(d: Spark, documents: str) -> str:
    """How much rarer than the commonest word, in powers of ten beyond three."""
    return f"WITH l AS ({_lexicon(d, documents, 3)}) SELECT term, n, round(greatest(0, log10(CAST((SELECT max(n) FROM l) AS DOUBLE) / n) - 3), 6) AS rarity FROM l"


#: Letters at either end of a word by which it meets terms, at most.
END = 6


def _ends(n: int) -> tuple[int, int]:
    """How many letters the two ends of a word of ``n`` letters have."""
    return min(n // 2, END), min(n - n // 2, END)


def _near_by_ends(d: Spark, words: str, terms: str, budgets: dict[int, str], budget: str, same_first: bool) -> str:
    """``near_pairs`` for up to three edits: one of a word's two ends has one edit at most, none if one is allowed.

    Ends don't shift, so a word's end but for one letter, and the ends of terms of about that length but for one letter or
    whole, are keys of an equi-join: some ten a word, some forty a term, whatever their lengths. Equal ends meet once: where the letters
    left out are the same, the first of them counts.
    """
    top = 2 * END + 2 * max(budgets)  # from here on all lengths have the same keys

    def keys(exact: bool, lengths: list[int], mine: bool, most: int) -> set[tuple]:
        """(kind, letters of the end, the one left out or 0)"""
        out = set()
        for side in (0, 1):
            for m in {_ends(n)[side] for n in lengths}:
                kind = 2 * side + exact
                whole, without = ([m], []) if exact else ([m], [m]) if mine else ([m - 1] if m else [0], [m, m + 1])
                out |= {(kind, k, 0) for k in whole if k <= most} | {(kind, k, i) for k in without if k <= most for i in range(1, k + 1)}
        return out

    asked = [(n, b, *k) for n in range(1, top + 1) for b in budgets for k in sorted(keys(b == 1, [n], True, n))]
    known = [(l, *k) for l in range(1, top + 1) for k in sorted({k for b in budgets for k in keys(b == 1, [n for n in range(max(1, l - b), min(top, l + b) + 1)], False, l)})]
    table = lambda rows, names: f"(SELECT * FROM (VALUES {', '.join(map(str, rows))}) v({names}))"
    end = lambda x: f"CASE WHEN kind < 2 THEN left({x}, m) ELSE right({x}, m) END"
    key = f"xxhash64(kind{', left(w, 1)' if same_first else ''}, CASE WHEN i = 0 THEN e ELSE concat(left(e, i - 1), substring(e, i + 1)) END) AS k, CASE WHEN i = 0 THEN 0 ELSE i * {1 << 21} + ascii(substring(e, i, 1)) END AS gone"
    reach = " OR ".join(f"(b = {b} AND {lengths.format(n='l')})" for b, lengths in budgets.items())
    return f"""
    WITH asked AS (SELECT w, length(w) AS n, CAST({budget} AS INT) AS b, {d.letters('w')} AS bits, {d.couples('w')} AS twos FROM ({words})),
    kinds AS (SELECT w, length(w) AS l, {d.letters('w')} AS bits, {d.couples('w')} AS twos FROM ({terms})),
    probes AS (SELECT w, bits, twos, n, b, {key} FROM (SELECT a.w, a.bits, a.twos, a.n, a.b, v.kind, v.i, {end('a.w')} AS e FROM asked a JOIN {table(asked, 'at, of, kind, m, i')} v ON v.at = least(a.n, {top}) AND v.of = a.b)),
    ends AS (SELECT w, bits, twos, l, {key} FROM (SELECT t.w, t.bits, t.twos, t.l, v.kind, v.i, {end('t.w')} AS e FROM kinds t JOIN {table(known, 'at, kind, m, i')} v ON v.at = least(t.l, {top})))
    SELECT DISTINCT w, term, dist FROM (SELECT {d.dealt('t')} a.w, t.w AS term, {d.within('a.w', 't.w', 'a.b')} AS dist FROM probes a JOIN ends t ON a.k = t.k AND t.l BETWEEN a.n - a.b AND a.n + a.b AND (a.gone <> t.gone OR a.gone < {2 << 21})
      WHERE {d.near('a.twos', 't.twos', 'a.b')} AND {d.apart('a.bits', 't.bits', 'a.b')} AND ({reach}){' AND left(a.w, 1) = left(t.w, 1)' if same_first else ''}) WHERE dist IS NOT NULL"""


def near_pairs(d: Spark, words: str, terms: str, budgets: dict[int, str], budget: str, same_first: bool = False) -> str:
    """(w, term, dist): the words and terms within a word's budget of edits. ``words`` and ``terms`` are queries of one column w of different strings.

    In Spark budgets of up to three edits go by the ends of words (see ``_near_by_ends``), and with ``same_first`` only pairs of one first letter are meant.

    A term is cut into one piece more than the edits allowed: one of them stands unchanged in any word within reach, at a place
    that its number and the two lengths leave little choice of. So words and terms meet by an equi-join on (budget, length of
    the term, number of the piece, piece), with some dozens of probes a word whatever its length; lengths that no term has aren't probed. The
    letters of both rule most pairs out, and the distance, bounded as well, decides. ``budget`` is a word's, ``budgets`` says for each which lengths ``n`` of a term it can reach.
    """
    if d.name == "spark" and max(budgets) <= 3:
        return _near_by_ends(d, words, terms, budgets, budget, same_first)
    start = lambda i: f"CAST(floor({i} * l / (b + 1)) AS BIGINT)"
    table = lambda rows, names: f"(SELECT {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in names.split(', '))} FROM (VALUES {', '.join(str(r) for r in rows)}) v({names}))"
    numbers = table([(b, i) for b in budgets for i in range(b + 1)], "b, i")
    # a word ``more`` letters longer than a term holds piece i at most i edits from its place, counted from either end
    shifts = table([(b, more, i, off) for b in budgets for more in range(-b, b + 1) for i in range(b + 1) for off in range(max(-i, more - b + i), min(i, more + b - i) + 1)], "b, more, i, shift")
    options = d.array(*[f"CAST({b} AS BIGINT)" for b in budgets])
    reach = " OR ".join(f"(b = {b} AND {lengths.format(n='l')})" for b, lengths in budgets.items())
    return f"""
    WITH asked AS (SELECT w, CAST(length(w) AS BIGINT) AS n, CAST({budget} AS BIGINT) AS b, {d.letters('w')} AS bits FROM ({words})),
    kinds AS (SELECT w, CAST(length(w) AS BIGINT) AS l, {d.letters('w')} AS bits FROM ({terms})),
    pieces AS (SELECT w, bits, b, l, i, substring(w, CAST({start('i')} + 1 AS INT), CAST({start('(i + 1)')} - {start('i')} AS INT)) AS piece FROM (SELECT w, bits, l, k.b, v.i FROM (SELECT w, bits, l, b FROM (SELECT w, bits, l, {options} AS bs FROM kinds) x {d.rows('bs', 'y', 'b')} WHERE {reach}) k JOIN {numbers} v ON v.b = k.b)),
    places AS (SELECT w, bits, n, b, l, i, {start('i')} + shift AS p, {start('(i + 1)')} - {start('i')} AS m FROM (SELECT w, bits, n, a.b, n - more AS l, i, shift FROM asked a JOIN {shifts} v ON v.b = a.b)),
    probes AS (SELECT w, bits, b, l, i, substring(w, CAST(p + 1 AS INT), CAST(m AS INT)) AS piece FROM (SELECT s.* FROM places s JOIN (SELECT DISTINCT l FROM kinds) k ON k.l = s.l) WHERE p >= 0 AND p <= n - m)
    SELECT DISTINCT w, term, dist FROM (SELECT {d.dealt('t')} a.w, t.w AS term, {d.within('a.w', 't.w', 'a.b')} AS dist FROM probes a JOIN pieces t ON a.b = t.b AND a.l = t.l AND a.i = t.i AND a.piece = t.piece WHERE {d.apart('a.bits', 't.bits', 'a.b')}) WHERE dist IS NOT NULL"""


#: Edits by the length of a word, and the lengths of terms within its reach.
BUDGET = "CASE WHEN length(w) <= 6 THEN 1 WHEN length(w) <= 10 THEN 2 ELSE 3 END"
BUDGETS = {1: "{n} <= 7", 2: "{n} BETWEEN 5 AND 12", 3: "{n} >= 8"}


def _nearest_terms(d: Spark, documents: str, ordinary: str, same: bool) -> str:
    words = f"SELECT lower(token) AS w, count(*) AS n, min(token) AS token FROM ({_tokens(d, documents, 'doc_id')}) GROUP BY lower(token)"
    known = f"SELECT t.w, t.n, t.token FROM ({words}) t LEFT JOIN {ordinary} o ON o.term = t.w WHERE o.term IS NULL AND length(t.w) >= 4"
    return _nearest(d, f"({known})", same)


def _nearest(d: Spark, known: str, same: bool) -> str:
    """The nearest term of each rare word of ``known`` (w, n, token), of its first letter if ``same``."""
    asked = f"SELECT w FROM {known} WHERE n = 1 AND token <> upper(token) AND position('-' IN w) = 0"
    pairs = near_pairs(d, asked, f"SELECT w FROM {known} WHERE n >= 5", BUDGETS, BUDGET, same)
    same = " WHERE left(w, 1) = left(term, 1)" if same else ""
    return f"""
    SELECT w AS word, min(term) AS term, CAST(min(dist) AS BIGINT) AS distance
    FROM (SELECT w, term, dist, min(dist) OVER (PARTITION BY w) AS least FROM ({pairs}){same}) WHERE dist = least GROUP BY w HAVING count(*) = 1"""


def _nearest_frame(same_first: bool):
    """The rows of ``_nearest_terms``. Words are counted once, as they stand before in lower case, and kept in the shared folder."""

    def run(documents: DataFrame, ordinary: DataFrame) -> DataFrame:
        spark = documents.sparkSession
        path = shared_folder(spark, "words")
        tokens = documents.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        words = tokens.groupBy(F.lower("token").alias("w")).agg(F.sum("n").alias("n"), F.min("token").alias("token")).where("length(w) >= 4")
        words.join(ordinary.select(F.col("term").alias("w")), "w", "left_anti").write.parquet(path)
        known = spark.read.schema("w string, n long, token string").parquet(path)
        return spark.sql(_nearest(SPARK, "{known}", same_first), known=known)

    return run


@operator("documents", "ordinary", frame=_nearest_frame(True))
def fuzzy_lexicon_match(d: Spark, documents: str, ordinary: str) -> str:
    """Rare words and the one lexicon term of the same first letter nearest in edit distance, within a budget by length; ties match nothing.

    Words and terms have four letters or more. Words all in capitals are acronyms, those with a hyphen compounds: neither is matched. Words of
    ``ordinary`` (term) are neither matched nor terms.
    """
    return _nearest_terms(d, documents, ordinary, True)


@operator("documents", "ordinary", frame=_nearest_frame(False))
def fuzzy_lexicon_match_any_letter(d: Spark, documents: str, ordinary: str) -> str:
    """As ``fuzzy_lexicon_match``, among terms of any first letter: a first letter misread, missing or too many is an edit like others."""
    return _nearest_terms(d, documents, ordinary, False)


@operator("benchmark")
def cer_pairs(d: Spark, benchmark: str) -> str:
    """Character error rates of items against a copy with letters swapped, in their own case and without, white space normalised, and whether they are equal.

    Everything is counted in code points; the word error rate is over words between white space. An empty item is right only as nothing.
    """
    ref = f"trim({d.replace('text', r'\s+', ' ')})"
    rate = lambda r, h: f"CASE WHEN length({r}) = 0 THEN CASE WHEN length({h}) = 0 THEN 0.0 ELSE 1.0 END ELSE round(least(1.0, CAST({d.edits(h, r)} AS DOUBLE) / length({r})), 6) END"
    coded = lambda x: d.joined(d.each(x, "w", d.letter(f"{'array_position' if d.name == 'spark' else 'list_position'}(u, w)")), "")
    wer = f"CASE WHEN {d.size('rs')} = 0 THEN CASE WHEN {d.size('hs')} = 0 THEN 0.0 ELSE 1.0 END ELSE round(least(1.0, CAST({d.edits(coded('hs'), coded('rs'))} AS DOUBLE) / {d.size('rs')}), 6) END"
    return f"""
    SELECT item_id, {rate('r', 'h')} AS cer, {rate('lower(r)', 'lower(h)')} AS cer_folded, {wer} AS wer, r = h AS exact
    FROM (SELECT *, {d.distinct(d.both('rs', 'hs'))} AS u FROM (SELECT *, {d.extract_all('r', r'[^ ]+')} AS rs, {d.extract_all('h', r'[^ ]+')} AS hs
      FROM (SELECT item_id, r, {d.replace(d.replace('r', 'th', 'ht'), '^([a-z])', '#')} AS h FROM (SELECT item_id, {ref} AS r FROM {benchmark}))))"""


@operator("notes")
def word_error_rates(d: Spark, notes: str) -> str:
    """Edits over words, case aside, between a line and the one below it, by the line's words, at most 1.

    Each word becomes a letter of its own, so that the distance of texts is that of words. A line without words gives 0
    for one without any, else 1.
    """
    coded = lambda words: d.joined(d.each(words, "x", d.letter(f"{'array_position' if d.name == 'spark' else 'list_position'}(u, x)")), "")
    return f"""
    SELECT page, line_number, CASE WHEN {d.size('a')} = 0 THEN CASE WHEN {d.size('b')} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE round(least(CAST(1 AS DOUBLE), CAST(levenshtein({coded('a')}, {coded('b')}) AS DOUBLE) / {d.size('a')}), 6) END AS wer
    FROM (SELECT page, line_number, a, b, {d.distinct(d.both('a', 'b'))} AS u
          FROM (SELECT page, line_number, {d.extract_all('r', r'\S+')} AS a, {d.extract_all('h', r'\S+')} AS b
                FROM (SELECT page, line_number, lower(coalesce(line, '')) AS r, lower(coalesce(lead(line) OVER (PARTITION BY page ORDER BY line_number), '')) AS h FROM {notes})))"""


#: A word and what stands around it; what stands beside a medicine's name.
CORE = r"^([^A-Za-z]*)([A-Za-z](?:[A-Za-z\x27-]*[A-Za-z])?)([^A-Za-z]*)$"
DOSE_OR_FORM = r"(?i)^(?:\d[\d./-]*\w*|mg|mcg|ml|gm|g|iu|tab|tabs|cap|caps|syp|inj|oint|od|bd|bid|tid|tds|qid|hs|sos|prn|stat|ac|pc|x\d+\w*)\.?$"
#: Words of notes that are known unless others are given.
COMMON = ("after", "and", "Ann", "as", "cough", "daily", "days", "diagnosis", "discharge", "fever", "food", "for", "gum", "hours", "name", "no", "pain", "paint", "patient", "review", "smoker", "summary", "topical", "twice", "weeks", "age", "adv", "every", "tab", "syp", "inj")


@operator("notes", known=COMMON, drugs=DRUGS, corrected=(("Smoker", "Smokr"),), other="replace(line, 'cough', 'pain')", sure=85, unsure=60, most=3, aligned=False)
def word_review(d: Spark, notes: str, known: tuple, drugs: tuple, corrected: tuple, other: str, sure: int, unsure: int, most: int, aligned: bool) -> str:
    """Words to look at, with their places (code points, end exclusive), why, and up to ``most`` suggestions.

    ``corrected``: a word that spelling made, with what was read. ``ambiguous``: known words that the ``other`` reading of the
    line has in its place, where both have as many words; if ``aligned``, by the column ``reading`` (see ``heard_words``) at any number of words. ``spelling``: three letters or more, not all capitals, neither ``known`` nor
    a drug; the nearest drugs, and known words unless it stands beside a dose. Names and drugs beside doses pass on lines of
    confidence ``sure`` or more, words with nothing near on those of ``unsure`` or more.
    """
    listed = lambda ts: d.array(*[quoted(t) for t in ts])
    isin = lambda w: f"lower({w}) IN ({', '.join(quoted(t.lower()) for t in (*known, *drugs))})"
    limit = "CASE WHEN length(word) <= 5 THEN 1 WHEN length(word) <= 9 THEN 2 ELSE 3 END"
    dist = "levenshtein(lower(word), lower(m))"
    near = lambda ts: d.each(d.distinct(d.each(d.only(listed(ts), "m", f"{dist} <= {limit} AND {dist} > 0"), "m", f"concat({dist}, m)")), "s", "substring(s, 2)")
    beside = " OR ".join(f"coalesce({d.matches(f'trim({f}(token) OVER w)', DOSE_OR_FORM)}, false)" for f in ("lag", "lead"))
    was = f"CASE word {' '.join(f'WHEN {quoted(now)} THEN {quoted(then)}' for now, then in corrected)} END"
    tokens = lambda x: d.extract_all(x, r"\s*\S+")
    heard, alike, others = ("try_element_at(others, i)", "true", "reading") if aligned else (d.at("others", "i + 1"), f"{d.size('pieces')} = {d.size('others')}", tokens(f"coalesce({other}, '')"))
    parts = d.only(d.extract_all("heard", "[A-Za-z]+"), "p", f"NOT ({isin('p')})")
    return f"""
    WITH t AS (SELECT page, line_number, conf, i, piece, {heard} AS heard, {alike} AS alike
               FROM (SELECT page, line_number, conf, {tokens("coalesce(line, '')")} AS pieces, {others} AS others FROM {notes}) x {d.numbered('pieces', 'y', 'i', 'piece')}),
    c AS (SELECT page, line_number, conf, i, alike, ltrim(piece) AS token, {d.extract('ltrim(piece)', CORE, 2)} AS word, coalesce(nullif({d.extract("coalesce(ltrim(heard), '')", CORE, 2)}, ''), ltrim(heard), '') AS heard,
                 CAST(sum(length(piece)) OVER (PARTITION BY page, line_number ORDER BY i) - length(piece) + length({d.extract('piece', '^' + chr(92) + 's*', 0)}) + length({d.extract('ltrim(piece)', CORE, 1)}) AS BIGINT) AS place FROM t),
    n AS (SELECT *, ({beside}) AS dosed FROM c WINDOW w AS (PARTITION BY page, line_number ORDER BY i)),
    s AS (SELECT *, {was} AS was, alike AND length(word) >= 2 AND {d.matches('heard', '[A-Za-z]{2}')} AND lower(heard) <> lower(word) AND {d.size(parts)} = 0 AS differs,
                 length(word) >= 3 AND word <> upper(word) AND NOT ({isin('word')}) AND NOT ((dosed OR (i > 0 AND {d.matches('word', '^[A-Z]')})) AND conf >= {sure}) AS strange FROM n WHERE word <> ''),
    f AS (SELECT *, CASE WHEN was IS NULL AND NOT differs AND strange THEN {d.first(f"CASE WHEN dosed THEN {near(drugs)} ELSE {near((*known, *drugs))} END", most)} END AS close FROM s)
    SELECT page, line_number, word, place AS first, place + length(word) AS last, CASE WHEN was IS NOT NULL THEN 'corrected' WHEN differs THEN 'ambiguous' ELSE 'spelling' END AS kind,
           CASE WHEN was IS NOT NULL THEN was WHEN differs THEN heard ELSE {d.joined('close', '|')} END AS suggestions
    FROM f WHERE was IS NOT NULL OR differs OR (strange AND ({d.size('close')} > 0 OR conf < {unsure}))"""


@operator("benchmark")
def bag_of_words_f1(d: Spark, benchmark: str) -> str:
    """F1 of word multisets of consecutive items: a full outer join of counts and the sum of the lesser."""
    t = _tokens(d, benchmark, "item_id")
    side = f"SELECT item_id, lower(token) AS w, count(*) AS n FROM ({t}) GROUP BY item_id, lower(token)"
    return f"""
    SELECT i AS item_id, round(CAST(2 * sum(least(a, b)) AS DOUBLE) / CAST(sum(a) + sum(b) AS DOUBLE), 6) AS f1
    FROM (SELECT coalesce(x.item_id, y.item_id - 1) AS i, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM ({side}) x FULL OUTER JOIN ({side}) y ON y.item_id = x.item_id + 1 AND y.w = x.w) GROUP BY i"""


@operator("notes")
def fact_f1(d: Spark, notes: str) -> str:
    """F1 of the sets of facts (drug, attribute, value) of each page's two halves."""
    facts = f"""SELECT page, line_number % 2 AS half, drug, a, v FROM (SELECT page, line_number, drug, 'strength' AS a, strength AS v FROM ({medicines(d, notes)}) WHERE form <> '' UNION ALL SELECT page, line_number, drug, 'frequency', frequency FROM ({medicines(d, notes)}) WHERE form <> '')"""
    return f"""
    WITH f AS (SELECT DISTINCT page, half, drug, a, v FROM ({facts}))
    SELECT page, round(CAST(2 * sum(shared) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS f1 FROM (SELECT page, CASE WHEN count(*) = 2 THEN 1 ELSE 0 END AS shared, count(*) AS n FROM f GROUP BY page, drug, a, v) GROUP BY page"""


@operator("boxes", conf_weight=0.6, validity_weight=0.4, bias=0.05)
def ensemble_choice(d: Spark, boxes: str, conf_weight: float, validity_weight: float, bias: float) -> str:
    """Which of two readings to keep: calibrated confidence and the share of known letters, with a preference for the first;
    an empty reading never, and never the second where it is the first behind a lone character."""
    def curve(c: str, xs: list[int], ys: list[int]) -> str:
        steps = [f"WHEN {c} <= {xs[0]} THEN CAST({ys[0]} AS DOUBLE)"]
        steps += [f"WHEN {c} <= {b} THEN {p} + ({c} - {a}) * {q - p} / CAST({b - a} AS DOUBLE)" for a, b, p, q in zip(xs, xs[1:], ys, ys[1:], strict=False)]
        return f"(CASE {' '.join(steps)} ELSE CAST({ys[-1]} AS DOUBLE) END) / 100"

    validity = lambda t: f"CAST(length({d.replace(t, '[^a-zA-Z0-9 ]', '')}) AS DOUBLE) / greatest(length({t}), 1)"
    score = lambda t, c: f"CASE WHEN trim({t}) = '' THEN CAST(-1 AS DOUBLE) ELSE {conf_weight} * ({c}) + {validity_weight} * ({validity(t)}) END"
    return f"""
    SELECT page, idx, round(a, 6) AS score_1, round(b, 6) AS score_2, lone, CASE WHEN lone OR a >= b THEN 'first' ELSE 'second' END AS choice
    FROM (SELECT page, idx, {score('word', curve('conf', [10, 50, 90], [0, 40, 95]))} + CASE WHEN trim(word) = '' THEN 0 ELSE {bias} END AS a, {score('other', curve('((conf * 7) % 100)', [20, 60, 95], [5, 50, 99]))} AS b,
                 word <> '' AND {d.matches('other', '^. ')} AND lower(substring(other, 3)) = lower(word) AS lone
          FROM (SELECT *, CASE conf % 4 WHEN 0 THEN '' WHEN 1 THEN concat('4 ', upper(word)) WHEN 2 THEN concat(word, '?!') ELSE word END AS other FROM {boxes}))"""


@operator("boxes")
def lines_from_words(d: Spark, boxes: str) -> str:
    """Words to lines, in order, with their mean confidence."""
    return f"SELECT page, CAST(floor(y1 / 40.0) AS BIGINT) AS line, {d.listagg('word', ' ', 'x1, idx')} AS body, round(CAST(sum(conf) AS DOUBLE) / count(*), 4) AS confidence FROM {boxes} GROUP BY page, floor(y1 / 40.0)"


@operator("notes", terms=(*DRUGS, *CLINICAL, "fever", "cough", "smoker"))
def number_accuracy(d: Spark, notes: str, terms: tuple) -> str:
    """How many of a line's numbers, and of its medical terms, the next line holds as well."""
    nums = lambda c: d.extract_all(c, "[0-9]+")
    words = d.extract_all("lower(line)", r"\b(" + "|".join(t.lower() for t in terms) + r")\b", 1)
    return f"""
    SELECT page, line_number, {d.size('own')} AS numbers, {d.size(d.only('own', 'n', 'position(n IN below) > 0'))} AS found, {d.size('terms')} AS terms, {d.size(d.only('terms', 'n', 'position(n IN lower(below)) > 0'))} AS terms_found
    FROM (SELECT page, line_number, {nums('line')} AS own, {words} AS terms, coalesce(lead(line) OVER (PARTITION BY page ORDER BY line_number), '') AS below FROM {notes})"""


@operator("pages")
def page_fields(d: Spark, pages: str) -> str:
    """Title, host and counts of raw pages."""
    return f"SELECT page_id, {d.extract('html', '<title>([^<]*)</title>', 1)} AS title, {d.extract('url', '^[a-z]+://([^/]+)', 1)} AS host, {d.size(d.extract_all('html', '<a '))} AS links, {d.size(d.extract_all('html', '<p>'))} AS paragraphs FROM {pages}"


@operator("conversations")
def case_and_spacing(d: Spark, conversations: str) -> str:
    """Case-folded, space-collapsed turns, and whether their first letter is a capital."""
    return f"SELECT conv_id, turn, md5(lower(trim({d.replace('text', r'[ \n\t]+', ' ')}))) AS folded, {d.matches('text', '^[A-Z]')} AS capital FROM {conversations}"
