"""Word lists, cues and units. They are defaults: every function that uses them takes others."""

# Fixed values.
STOP_WORDS = ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "de", "des", "du", "et", "la", "le", "les", "un", "une", "der", "die", "das", "und", "von", "el", "los", "que", "y"]
SUFFIXES = ["tions", "tion", "ings", "ing", "ment", "edly", "ed", "ly", "es", "er", "ung", "heit", "keit", "lich", "ción", "mente"]
CONTEXT_ENDINGS = ["tion", "ment", "ing", "ung", "ed", "es", "er", "en", "e", "s"]
# unit, base unit, factor: seconds and hours are different dimensions
UNITS = [("ms", "s", "0.001"), ("s", "s", "1"), ("min", "s", "60"), ("h", "h", "1"), ("days", "h", "24"), ("MB", "GB", "0.001"), ("GB", "GB", "1")]
OPERATORS = {"not more than": "<=", "at most": "<=", "≤": "<=", "<=": "<=", "not less than": ">=", "at least": ">=", "≥": ">=", ">=": ">=", "equal to": "=", "=": "="}
MODALITIES = [("prohibited", r"\b(must not|shall not|may not|prohibited)\b"), ("recommended", r"\b(should|recommended)\b"), ("permitted", r"\b(may|permitted)\b"), ("mandatory", r"\b(must|shall|required)\b")]
SMALL_NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
