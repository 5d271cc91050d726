"""Training targets and chat messages as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.labels import alternative_of, polarity_of
from glyphloom.functions.text import irony_rule

# Our own wording; callers with another prompt pass ``system=`` instead.
INSTRUCTIONS = (
    "You judge which emoji fits a short social media text.\n"
    "Describe its tone in one sentence, say whether it is ironic, sarcastic or "
    "slang, choose the best emoji, a second choice, and give a short reason.\n"
    "{allowed}"
    'Answer with one JSON object with the keys "tone", "irony" (true or false), '
    '"primary", "alternative" and "reason".'
)
ALLOWED_LINE = "Use only these emoji: {emoji}\n"


def system_prompt(constrain: bool = True) -> str:
    """The system message, with or without the list of allowed emoji."""
    allowed = ALLOWED_LINE.format(emoji=" ".join(V.EMOJI)) if constrain else ""
    return INSTRUCTIONS.format(allowed=allowed)


# Tone and reason wording of the targets.
TONE = "{} emotional tone"
IRONIC_TONE = "Ironic or sarcastic"
REASON = "The text conveys a {} sentiment, best matched by {}."


def json_escaped(value: Column) -> Column:
    """A string as it stands between the quotes of a JSON string."""
    as_array = F.to_json(F.array(value))
    inside = F.substring(as_array, F.lit(3), F.length(as_array) - 4)
    return F.when(value.rlike(r'["\\\x00-\x1f]'), inside).otherwise(value)


def _by_polarity(emoji: Column, of: dict[str, str]) -> Column:
    positive = polarity_of(emoji) == V.POSITIVE
    return F.when(positive, of[V.POSITIVE]).otherwise(of[V.NOT_POSITIVE_NAME])


def _polarities(template: str) -> dict[str, str]:
    return {p: template.replace("{}", p, 1) for p in (V.POSITIVE, V.NOT_POSITIVE_NAME)}


def target_struct(emoji: Column, text: Column) -> Column:
    """The structured answer a model is trained to give for a labelled text."""
    tones = {p: TONE.format(p.capitalize()) for p in (V.POSITIVE, V.NOT_POSITIVE_NAME)}
    ironic = irony_rule(text)
    tone = F.when(ironic, TONE.format(IRONIC_TONE)).otherwise(_by_polarity(emoji, tones))
    reason = F.replace(_by_polarity(emoji, _polarities(REASON)), F.lit("{}"), emoji)
    return F.struct(
        tone.alias("tone"), ironic.alias("irony"), emoji.alias("primary"),
        alternative_of(emoji).alias("alternative"), reason.alias("reason"),
    )


def training_target(emoji: Column, text: Column) -> Column:
    """The structured answer as JSON text, ``", "`` and ``": "`` separated.

    Null where the emoji is null (a row without a usable label).  The keyword
    rule is evaluated once: it chooses between whole beginnings.
    """
    def start(tone: str, irony: str) -> str:
        return '{"tone": "' + TONE.format(tone) + '", "irony": ' + irony + ', "primary": "'

    plain = {
        p: start(p.capitalize(), "false") for p in (V.POSITIVE, V.NOT_POSITIVE_NAME)
    }
    first = F.when(irony_rule(text), start(IRONIC_TONE, "true")).otherwise(
        _by_polarity(emoji, plain)
    )
    # the emoji goes where the reason's second gap is
    before = {p: reason.split("{}")[0] for p, reason in _polarities(REASON).items()}
    after = REASON.split("{}")[-1]
    shown = json_escaped(emoji)
    written = F.concat(
        first, shown, F.lit('", "alternative": "'), alternative_of(emoji),
        F.lit('", "reason": "'), _by_polarity(emoji, before), shown, F.lit(after + '"}'),
    )
    return F.when(emoji.isNotNull(), written)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(
    text: Column, target: Column | None = None, constrain: bool = True, system: str | None = None
) -> Column:
    """``array<struct<role, content>>``: system, user and, with a target, assistant."""
    asked = [
        _message("system", F.lit(system if system is not None else system_prompt(constrain))),
        # Wording around the text in the user message.
        _message("user", F.concat(F.lit("Text: "), text, F.lit("\nAnalyze and predict:"))),
    ]
    if target is None:
        return F.array(*asked)
    answered = F.array(*asked, _message("assistant", target))
    return F.when(target.isNull(), F.array(*asked)).otherwise(answered)


def render_message(role: Column, content: Column) -> Column:
    """One message in a generic role-tagged form."""
    return F.concat(F.lit("[["), role, F.lit("]]\n"), content, F.lit("\n"))


def render_chat(messages: Column, add_generation_prompt: bool = False) -> Column:
    """All messages of a chat as one string, optionally opened for the answer."""
    text = F.array_join(F.transform(messages, lambda m: render_message(m.role, m.content)), "")
    return F.concat(text, F.lit("[[assistant]]\n")) if add_generation_prompt else text
