"""Word lists and patterns that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Stop words dropped from objectives.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "had", "has", "have", "he", "her", "hers", "him", "his", "i", "in", "into", "is", "it", "its", "me",
    "my", "of", "on", "or", "our", "ours", "she", "that", "the", "their", "theirs", "them", "they", "this", "those", "to", "us", "was", "we", "were", "with", "you", "your", "yours",
)
# First words that make a line a question.
QUESTION_STARTERS = (
    "am", "are", "can", "could", "did", "do", "does", "explain", "has", "have", "how", "is", "shall", "should", "tell", "was", "were", "what", "when", "where", "which", "who", "why", "will", "would",
)
# Phrases of feedback, correction, reasoning and uncertainty.
FEEDBACK = ("correct", "exactly", "excellent", "good job", "great", "nice", "perfect", "right", "that's it", "thats it", "well done", "yes")
CORRECTION = ("be careful", "check that", "incorrect", "instead", "mistake", "no", "not quite", "try again", "wrong")
REASONING = ("because", "equals", "first", "i think", "if", "means", "since", "so", "then", "therefore")
UNCERTAINTY = ("confused", "don't know", "dont know", "guess", "i'm not sure", "im not sure", "maybe", "not sure", "unsure")
# Phrases of action labels.
HINT = ("here's a hint", "heres a hint", "think about", "remember that", "what if you", "consider", "recall that", "a clue")
EXPLANATION = ("the answer is", "you need to", "here is how", "here's how", "the rule is", "this means")
CONFIDENCE = ("i know", "i'm sure", "im sure", "definitely", "easy", "of course", "i'm confident", "im confident")
ACTION_REASONING = ("because", "equals", "first", "i think", "since", "so", "then", "therefore")
ACTION_UNCERTAINTY = ("confused", "don't know", "dont know", "guess", "not sure", "unsure", "maybe")
# Patterns of session views, between characters that are not of a word.
UNCLEAR_PATTERN = r"idk|unsure|confused|unclear|i\s+(?:do\s*not|don't|dont)\s+know|(?:do\s*not|don't|dont)\s+understand|not\s+sure|no\s+idea"
FEEDBACK_PATTERN = r"correct|exactly|excellent|good|great|nice|yes|well\s+done|that(?:'s|\s+is)\s+right|you\s+got\s+it"
CORRECTION_PATTERN = r"incorrect|mistake|instead|actually|careful|not\s+quite|try\s+again|let(?:'s|\s+us)\s+correct"


@dataclass(frozen=True)
class Lexicon:
    """The phrase lists of line flags and action labels."""

    feedback: tuple[str, ...] = FEEDBACK
    correction: tuple[str, ...] = CORRECTION
    reasoning: tuple[str, ...] = REASONING
    uncertainty: tuple[str, ...] = UNCERTAINTY
    hint: tuple[str, ...] = HINT
    explanation: tuple[str, ...] = EXPLANATION
    confidence: tuple[str, ...] = CONFIDENCE
    action_reasoning: tuple[str, ...] = ACTION_REASONING
    action_uncertainty: tuple[str, ...] = ACTION_UNCERTAINTY
    starters: tuple[str, ...] = QUESTION_STARTERS


@dataclass(frozen=True)
class Budgets:
    """Extraction limits, in characters or lines."""

    context: int = 4096
    role: int = 3072
    window: int = 4096
    edges: int = 2048
    top_k: int = 12
    radius: int = 1
    edge_lines: int = 10
    max_gap: int = 4
