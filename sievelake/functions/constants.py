"""Fixed sets: white space, missing-value tokens, line separators, thresholds."""

#: All characters that Unicode counts as white space, as a strip set.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Cell contents that stand for a missing value in a CSV file.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Separators of lines in a text, as a Java regular expression.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
IQR_FACTOR = 1.5
SMALL_SIDE = 100
BLUR_LIMIT = 50.0
QUALITY_LIMIT = 0.6
CONFIDENCE_PERCENTILE = 0.85
DEFAULT_THRESHOLD = 0.5
FOLDS = 5
ISSUE_SCHEMA = "modality string, type string, column string, row_id long, original_row_id long, count long, percentage double, original_label int, predicted_label int, quality_score double, height int, width int, sharpness double, error string"
