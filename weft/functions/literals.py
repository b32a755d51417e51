"""The literals, profiles and patterns that results depend on."""

#: Prefix punctuation in the order in which it is tried.
PREFIX_PUNCTUATION = (
    "'(", "‘(", "’(", '"(', "“(", "”(", "'[", "‘[", "’[", '"[', "“[", "”[", "('", "(‘", "(’", "-(", "-[",
    "'", "‘", "’", '"', "“", "”", "`", "(", "[", "{", "-",
)
#: Two-character suffix punctuation in the order in which it is tried.
SUFFIX_PAIRS = (
    ")'", ")’", ')"', ")”", "]'", "]’", ']"', "]”", ".'", ".’", '."', ".”", "!'", "!’", '!"', "!”", "?'", "?’", '?"', "?”",
    ",'", ",’", ',"', ",”", "',", "’,", '",', "”,", "'.", "’.", '".', "”.", ".)", ").", "!)", "?)", ",)", ")-", "]-",
)
#: Possessive endings, as suffix punctuation tries them and as a group of their own does.
SUFFIX_POSSESSIVES = ("'s", "s'", "’s", "s’")
POSSESSIVES = ("'s", "’s", "s'", "s’")
#: One-character suffix punctuation.
SUFFIX_SINGLES = ("'", "‘", "’", '"', "“", "”", "`", ")", "]", "}", ".", "!", "?", ",", ";", ":", "-")
#: Determiners.
ARTICLES = ("the", "a", "an")
POSSESSIVE_DETERMINERS = ("my", "your", "his", "her", "our", "their", "its")
DEMONSTRATIVES = ("this", "that", "these", "those")
QUANTIFIERS = ("some", "any", "no", "all", "both", "each", "every", "several", "many", "much", "more", "most", "few", "fewer", "little", "less", "another")
#: Preposition profiles.
PREPOSITIONS = {
    "core": ("by", "at", "of", "to", "in", "on", "with", "for", "from"),
    "expanded": (
        "by", "at", "of", "to", "in", "on", "with", "for", "from", "about", "across", "after", "against", "around", "before", "between",
        "during", "inside", "into", "onto", "over", "through", "under", "without",
    ),
    "full": (
        "about", "above", "across", "after", "against", "along", "amid", "among", "around", "at", "before", "behind", "below", "beneath",
        "beside", "between", "beyond", "by", "despite", "during", "for", "from", "in", "inside", "into", "near", "of", "on", "onto", "outside",
        "over", "through", "throughout", "to", "toward", "towards", "under", "underneath", "until", "upon", "with", "within", "without", "per", "via",
    ),
}
#: Words and pre-token patterns.
WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"
APOSTROPHES = "['`‘’ʼ׳]"
BASELINE_PATTERN = rf" ?-?\p{{L}}+(?:{APOSTROPHES}\p{{L}}+)*|\p{{N}}{{1,2}}| ?[^\s\p{{L}}\p{{N}}]++[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
ISOLATING_PATTERN = rf"\p{{L}}+(?:{APOSTROPHES}\p{{L}}+)*|\p{{N}}{{1,2}}|[^\s\p{{L}}\p{{N}}]++|\s+"
STAGE2_SEPARATORS = r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]{2,}[\r\n/]*| +(?!\S)"
STAGE2_PATTERN = rf"{STAGE2_SEPARATORS}|(?:[\s\S]+?(?=(?:{STAGE2_SEPARATORS}|\z)))"
#: Special tokens, in id order.
SPECIAL_TOKENS = (
    "<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>",
)
#: Punctuation that text normalization for answers drops.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Garbled quotation marks and dashes and what they stand for, in the order in which they are replaced.
MOJIBAKE = (
    ("\u00e2\u0122\u013b", "\u2019"), ("\u00e2\u0122\u013a", "\u2018"), ("\u00e2\u0122\u013e", "\u201c"), ("\u00e2\u0122\u013f", "\u201d"),
    ("\u00e2\u0122\u00a6", "\u2026"), ("\u00e2\u0122\u0094", "\u2014"), ("\u00e2\u0122\u0093", "\u2013"),
    ("\u00e2\u20ac\u2122", "\u2019"), ("\u00e2\u20ac\u02dc", "\u2018"), ("\u00e2\u20ac\u0153", "\u201c"), ("\u00e2\u20ac\u009d", "\u201d"),
    ("\u00e2\u20ac\u00a6", "\u2026"), ("\u00e2\u20ac\u201d", "\u2014"), ("\u00e2\u20ac\u201c", "\u2013"),
)
