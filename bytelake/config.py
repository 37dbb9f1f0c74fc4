"""Configuration as frozen dataclasses; defaults are the values the reference scripts use."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the reference for identical results.
BOS = 254  # beginning-of-sequence byte
EOS = 255  # end-of-sequence byte
PAD = 0  # padding byte; also the masked target
VOCAB = 256
THINK_TAG = "<think>"
THINK_END_TAG = "</think>"
ANSWER_TAG = "<answer>"
ANSWER_END_TAG = "</answer>"
SHORT_SYSTEM_PROMPT = "just think before answer."
AUGMENT_THINKING = "Let me think about this carefully... This requires analyzing the logical structure."
AUGMENT_ANSWER = "This statement exhibits the post hoc fallacy, assuming correlation implies causation."
PLACEHOLDER_TEXT = "This is a placeholder text."
DECODE_ERROR_MESSAGE = "Error: Unable to decode generated response."
CONTENT_COLUMN_NAMES = ("text", "content", "body", "document")
REWARD_SCALES = (1.0, 1.5, 2.0, 2.5)
MOCK_PROMPT = "Logic problem #{i}: Given the premises..."
MOCK_RESPONSE = (
    "<think>Let me analyze this step by step...\n1. First premise implies...\n"
    "2. Second premise states...\n3. Combining these, we can deduce...\n</think>\n"
    "<answer>Therefore, the conclusion is valid/invalid because...</answer>"
)


@dataclass(frozen=True)
class WeightConfig:
    alpha: float = 0.5
    min_freq: float = 1e-5
    max_weight: float = 10.0
    kl_lambda: float = 0.1


@dataclass(frozen=True)
class RewardConfig:
    base_reward: float = 1.0
    base_penalty: float = -0.5
    max_penalty_scale: float = 2.5
    reward_weight: float = 0.7
    kl_coef: float = 0.1
    accumulation: int = 4
    scales: tuple = REWARD_SCALES

