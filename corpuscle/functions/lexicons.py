"""Word lists and tables that results depend on. All entries are fixed values."""

# English stop words of the retrieval tokenizer.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from up about into through during is are was were be been being have has had do does did "
    "will would could should may might shall this that these those i we you he she they it its our their his her not no nor so yet both either "
    "whether because while although however therefore thus hence also then than as if when where which who whom what how paper show propose "
    "present approach method model result experiment using use based can new"
).split()

# Words a query's terms don't count (English, French, Arabic, general research words).
QUERY_STOP_WORDS = (
    "a an and are as at be between by can compare comparison do does for from how in is it of on or the their this to vs versus what which with "
    "within better difference au aux ce ces dans de des du elle en entre est et la le les leur mais par pas pour que qui sur un une هذا هذه ذلك "
    "التي الذي الى الي على عن بين في من ماذا مقارنة مقارنه مقابل ضد accuracy approach approaches benchmark benchmarks data dataset datasets "
    "effect evaluation experiment experiments improve improved improvement method methods model models performance result results study studies "
    "task tasks work"
).split()

# Accented Latin letters and their plain forms in keys.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Words that hint at a French query.
FRENCH_HINTS = (
    "avec sans dans pour entre contre et faible faibles ressource ressources complet complete complets completes comparaison compare donnees "
    "resultats etude apprentissage limitees limite"
).split()

# How a query compares two things: verb, preposition and conjunction around them, or a connector between them.
COMPARING = (("مقارنة", "بين", "و"), ("compare|comparison", "between", "and"), ("comparaison|comparer|compare", "entre", "et"))
CONNECTORS = ("vs", "versus", "against", "contre", r"face\s+(?:à|a)", r"comparé(?:e|s|es)?\s+(?:à|a)", r"compared\s+(?:to|with)", "مقابل", "ضد")

# Fixed value: the pattern of a metric and its number, or of a number and its metric.
METRIC_PATTERN = r"(?:(bleu|rouge[-\w]*|bertscore|meteor|chrf|comet|bleurt|f[-\s]?1|accuracy|precision|recall|em|exact\s+match|mrr|map|ndcg|perplexity|auc|mse|rmse|mae)[\s\w]{0,15}?(\d+\.?\d*)|(\d+\.?\d*)\s*(%|percent|points?)(?:\s+(?:on|for|in|at))?[\s\w]{0,20}?(bleu|rouge[-\w]*|f[-\s]?1|accuracy|precision|recall)?)"

# Last words of an incomplete sentence.
TRAILING_WORDS = "a an and as at because by for from in into of on or that the to using with which".split()

# Words that a rewritten sentence keeps or loses only with its sense, and words it may add or leave out.
POLARITY = "no not never without cannot lack lacks fail fails".split()
HEDGES = "may might could suggest suggests possibly likely potentially".split()
GRAMMATICAL = (
    "a about after also an are be been being but can could did does during each from has have if into its more most not our over per than their there "
    "these they this those was were will would we such that then through under use used using very while who whose you your"
).split()

# Claim vocabulary.
CONTRIBUTION_VERBS = "propose introduce present describe develop design build implement create construct extend augment combine integrate".split()
COMPARISON_VERBS = "outperform surpass exceed beat compare versus against baseline".split()
LIMITATION_MARKERS = ["limit", "limitation", "restrict", "constrain", "fail", "cannot", "unable", "struggle", "challenging", "difficult", "future work", "remain", "require"]
HEDGING_VERBS = "suggest indicate appear seem tend imply hypothesize conjecture speculate".split()
MODAL_HEDGED = "may might could would should".split()
MODAL_SPECULATIVE = "possibly potentially perhaps presumably arguably".split()
FUTURE_MARKERS = ["future work", "future research", "remains to", "plan to"]
RELEASE_VERBS = "collect annotat release introduc curate".split()
KNOWN_DATASETS = (
    "squad squad2 hotpotqa naturalquestions triviaqa msmarco fever nli snli mnli glue superglue wmt conll ontonotes ptb cnn/dailymail xsum newsqa "
    "coqa quac boolq commonsenseqa winogrande hellaswag mmlu bbh gsm8k humaneval mbpp"
).split() + ["penn treebank"]
KNOWN_MODELS = (
    "bert roberta deberta electra albert gpt gpt-2 gpt-3 gpt-4 chatgpt llama llama-2 llama-3 mistral falcon t5 flan-t5 mt5 bart pegasus xlm xlm-r "
    "xlmroberta camembert flaubert sentence-bert sbert specter scibert biobert lora qlora peft adapter"
).split()
METRIC_NAMES = (
    "bleu rouge rouge-1 rouge-2 rouge-l f1 accuracy precision recall em mrr map ndcg perplexity bertscore meteor chrf comet bleurt auc mse rmse mae"
).split() + ["exact match"]

# Provider licence name -> (family, SPDX id where the name is exact).
LICENCES = {
    "cc-by": ("cc-by", None),
    "cc-by-4.0": ("cc-by", "CC-BY-4.0"),
    "cc-by-3.0": ("cc-by", "CC-BY-3.0"),
    "cc-by-nc": ("cc-by-nc", None),
    "cc-by-nc-4.0": ("cc-by-nc", "CC-BY-NC-4.0"),
    "cc-by-nc-3.0": ("cc-by-nc", "CC-BY-NC-3.0"),
    "cc-by-sa": ("cc-by-sa", None),
    "cc-by-sa-4.0": ("cc-by-sa", "CC-BY-SA-4.0"),
    "cc-by-sa-3.0": ("cc-by-sa", "CC-BY-SA-3.0"),
    "cc-by-nd": ("cc-by-nd", None),
    "cc-by-nd-4.0": ("cc-by-nd", "CC-BY-ND-4.0"),
    "cc-by-nd-3.0": ("cc-by-nd", "CC-BY-ND-3.0"),
    "cc-by-nc-sa": ("cc-by-nc-sa", None),
    "cc-by-nc-sa-4.0": ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"),
    "cc-by-nc-sa-3.0": ("cc-by-nc-sa", "CC-BY-NC-SA-3.0"),
    "cc-by-nc-nd": ("cc-by-nc-nd", None),
    "cc-by-nc-nd-4.0": ("cc-by-nc-nd", "CC-BY-NC-ND-4.0"),
    "cc-by-nc-nd-3.0": ("cc-by-nc-nd", "CC-BY-NC-ND-3.0"),
    "cc0": ("cc0", None),
    "cc0-1.0": ("cc0", "CC0-1.0"),
    "public-domain": ("public-domain", None),
    "apache-2.0": ("apache-2.0", "Apache-2.0"),
    "mit": ("mit", "MIT"),
    "all-rights-reserved": ("all-rights-reserved", None),
    "elsevier-user-license": ("restricted", None),
    "proprietary": ("restricted", None),
    "restricted": ("restricted", None),
}

# Heading patterns in order -> section type.
SECTION_PATTERNS = (
    (r"^abstract\b", "abstract"),
    (r"^1\.?\s*introduction\b", "introduction"),
    (r"^related\s+work\b", "related_work"),
    (r"^background\b", "related_work"),
    (r"^(2|3)\.?\s*(method|approach|model|system)\b", "method"),
    (r"^(3|4)\.?\s*(experiment|setup|dataset)\b", "experiment"),
    (r"^(4|5)\.?\s*(result|evaluation|analysis)\b", "results"),
    (r"^discussion\b", "discussion"),
    (r"^(5|6|7)\.?\s*conclusion", "conclusion"),
    (r"^limitation\b", "limitations"),
    (r"^acknowledgement\b", "acknowledgements"),
    (r"^reference\b", "references"),
    (r"^appendix\b", "appendix"),
)
