"""Patterns, markers and prompt wording that results must agree on.

Everything here is data stated as text. Prompt lines are joined by a newline and an indent;
``{name}`` marks where a column is put in.
"""

# Identifier patterns, in the order in which mentions are listed.
MENTION_PATTERNS = (r"wd:Q\d+", r"wdt:P\d+", r"p:P\d+", r"ps:P\d+", r"pq:P\d+")

# Placeholder for a text that is missing.
MISSING_TEXT = "n/a"

# What encloses the text in one line of a raw response body.
CHUNK_START = 'response":"'
CHUNK_END = '","done":'

# Turn markers of the tagged prompt style.
BEGIN = "<|begin_of_text|>"
SYSTEM_TURN = "<|start_header_id|>system<|end_header_id|>"
USER_TURN = "<|eot_id|><|start_header_id|>user<|end_header_id|>"
ASSISTANT_TURN = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>"

# Indents of a first prompt and of a refinement prompt.
FIRST_INDENT = " " * 12
REFINE_INDENT = " " * 16

# Wording.
TRANSLATOR_ROLE = "You are a AI translator for converting sparql queries into normal natural language questions"
TASK = (
    "Translate the sparql query into natural language; formulate the response as a question "
    "and respond in one sentence only with the translation itself: "
)
WORKED_QUERY = (
    "select distinct ?obj where { [Delta Air Lines] [house publication] ?obj . "
    "?obj [instance of] [periodical] }"
)
WORKED_QUESTION = "What periodical literature does Delta Air Lines use as a moutpiece?"
CONTEXT = "Here are some contextual data to the query, remember it when translating: "
REFLECT = (
    "Reflect on your answer and improve upon it; "
    "respond with only the improved question in one sentence only"
)
CRITIC_ROLE = "You are a AI translator for selecting the best natural language translation of a sparql query."
CRITIC_TASK = (
    "Select only a single translation from the list of given translations that is the best "
    "equivalent of the sparql query. Translations: {candidates}, Query: {query}. "
    "Respond with the selected translation only."
)
JUDGE_TASK = "Respond with a single word. Are the following sentences semantically the same?:"
JUDGE_BLANK = "XXXXX."

# Defaults.
FEWSHOT_ROWS = 200
COMPARE_ROWS = 30
SCORE_LIMIT = 0.87
THRESHOLD_START = 0.1
THRESHOLD_RATE = 0.01
THRESHOLD_STEPS = 50
MAX_TOKENS = 512
