"""Constants of the evaluation protocol.

FIXED VALUES — these must equal the original protocol for results to agree.
They are stated plainly, in their natural order.
"""

# ---- fixed values: label domains -------------------------------------------
EMOTIONS = ["anger", "love", "joy", "surprise", "fear", "sadness", "undefined"]
EMOTION_CLASSES = ["positive", "negative"]
CORRUPTED = "corrupted"
UNUSABLE_LEVEL = -1

# ---- fixed values: evaluation grid ------------------------------------------
PERSONAS = ["persona_1", "persona_2"]
BASELINE_PERSONA = "assistant"          # persona key of the shared no-context run
SEEDS = [7, 33, 42]
APPROACHES = ["no_context", "context_zero_shot", "context_few_shot_5",
              "context_few_shot_10", "context_fine_tuning"]
BASELINE_APPROACH = "no_context"
LABEL_FIELDS = ["emotion", "emotion_class", "trigger_level"]

# ---- fixed values: splitting -----------------------------------------------
FT_TRAIN_NUM = 50
FT_VAL_NUM = 20
SPLIT_NAMES = ["ft_training", "ft_validation", "evaluation"]

# ---- fixed values: scoring --------------------------------------------------
FAILED_OUTPUT_JSON = '{"response": "failed to generate"}'
FEW_SHOT_EXAMPLES = 10
TEMPERATURE = 0.2
MAX_TOKENS = 4096
# envelope default only (the scorer is the caller's)
MODEL_NAME = "chat-model"

# ---- fixed values: fine-tuning cost estimate --------------------------------
MAX_TOKENS_PER_EXAMPLE = 10e6
TARGET_EPOCHS = 3
MIN_TARGET_EXAMPLES = 50
MAX_TARGET_EXAMPLES = 200
MIN_DEFAULT_EPOCHS = 1
MAX_DEFAULT_EPOCHS = 25
TOKENS_PER_MESSAGE = 3
TOKENS_PER_NAME = 1
REPLY_PRIMING_TOKENS = 3
PRICE_PER_MILLION = 8

# ---- fixed values: annotation export vocabulary ------------------------------
EXPORT_EMOTION = "emotion"
EXPORT_EMOTION_CLASS = "emotion_class"
EXPORT_TRIGGER_LEVEL = "trigger_level_1_low_5_high"
EXPORT_DESCRIPTION = "optional_description"
EXPORT_PHRASES = "emotional_triggering_phrases"
PSEUDONYM_HEX_CHARS = 8

# ---- prompt templates (our own wording; only the placeholders are fixed) -----
CONTEXT_TOKEN = "{CONTEXT}"
PUBLICATION_TOKEN = "{PUBLICATION}"
FENCED_PUBLICATION_TOKEN = "```{PUBLICATION}```"
CLUSTER_TOKEN = "{CLUSTER_DESCRIPTION}"

EVALUATE_TEMPLATE = [
    ("system",
     "{CONTEXT}\nRead the publication and report, as a JSON object, the main emotion it causes you "
     "(anger, fear, joy, love, sadness, surprise or undefined), whether that emotion is positive or "
     "negative, its strength from 1 to 5, the phrases of the text that cause it (a list of strings), "
     "and a short reason."),
    ("user", "Here is the publication to label:\n```{PUBLICATION}```"),
]

PERSONA_TEMPLATE = [
    ("system",
     "Turn the description of a group of people into a short narrative profile of one person of "
     "that group, written in the second person and at most 100 words long."),
    ("user", "Group description: {CLUSTER_DESCRIPTION}"),
]
