"""Texts of prompts, requests and reports as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cameras and how prompts name them.
VIEWS = {"head": "head camera", "chest": "chest camera"}


def folder_name(address: Column) -> Column:
    """An address as a name of letters, digits, dots and dashes; ``unknown`` if nothing is left."""
    plain = F.regexp_replace(F.coalesce(address, F.lit("")), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.btrim(plain, F.lit("_")), F.lit("")), F.lit("unknown"))


def byte_size(n: Column) -> Column:
    """Units and their digits."""
    kilo, mega = F.format_string("%.2f KB", n / 1024.0), F.format_string("%.2f MB", n / 1048576.0)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 1048576, kilo).otherwise(mega)


def views_fail(views: Column) -> Column:
    """No views, or one that is no camera."""
    return F.coalesce((F.size(views) == 0) | (F.size(F.array_except(views, F.array(*map(F.lit, VIEWS)))) > 0), F.lit(True))


def view_order(views: Column) -> Column:
    """Which video is from which camera, of one or two views. Its sentences."""
    name = lambda v: F.element_at(F.create_map(*(F.lit(x) for kv in VIEWS.items() for x in kv)), v)
    first, second = name(F.get(views, 0)), name(F.get(views, 1))
    two = F.concat(F.lit("There are two videos: the first video is from the "), first, F.lit("; the second video is from the "), second, F.lit("."))
    return F.when(F.size(views) == 1, F.concat(F.lit("The video is from the "), first, F.lit("."))).otherwise(two)


#: Sentences of a task's prompt, and marks that stand for a state, an action and a camera in it.
TASK, STATES, CAMERA = "Task: ", "States: ", " camera intrinsics: "
NEXT, NEXT_FRAMES = " Predict the next action sequence.", " Predict the next action sequence and future frames."
STATE_MARK, ACTION_MARK, CAMERA_MARK = "<state>", "<action>", "<camera>"


def camera_text(view: Column, intrinsic: Column, marks: bool = False) -> Column:
    """A camera's numbers with two digits, or, with ``marks``, a mark that a model fills with them."""
    numbers = F.format_string("fx:%.2f fy:%.2f cx:%.2f cy:%.2f", *(F.get(intrinsic, k).cast("double") for k in range(4)))
    return F.concat(F.initcap(view), F.lit(CAMERA), F.lit(CAMERA_MARK) if marks else numbers, F.lit("."))


def task_prompt(instruction: Column, views: Column, intrinsics: Column, n_states: Column, marks: bool = False, frames: bool = False) -> Column:
    """What a task asks: the instruction, which video is from which camera, the cameras of the active views in their
    order, and a mark to each state. ``intrinsics`` maps a view to its four numbers; a view without any is an error,
    unless marks stand for them."""
    lost = F.raise_error(F.lit("an active view has no intrinsic")).cast("array<double>")
    one = lambda v: camera_text(v, F.lit(None) if marks else F.coalesce(F.element_at(intrinsics, v).cast("array<double>"), lost), marks)
    cameras = F.array_join(F.transform(views, one), " ")
    text = F.concat(F.lit(TASK), instruction, F.lit(". "), view_order(views), F.lit(" "), cameras, F.lit(" " + STATES), F.repeat(F.lit(STATE_MARK), n_states), F.lit("."))
    return F.concat(text, F.lit(NEXT_FRAMES if frames else NEXT))


def task_messages(prompt: Column, views: Column, n_actions: Column, prompt_only: Column) -> Column:
    """User and assistant turns of a task: a placeholder to each view's video before the text, a mark to each action."""
    part = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    videos = F.transform(views, lambda _: part(F.lit("video"), F.lit(None).cast("string")))
    user = F.array(turn("user", F.concat(videos, F.array(part(F.lit("text"), prompt)))))
    answer = F.array(turn("assistant", F.array(part(F.lit("text"), F.repeat(F.lit(ACTION_MARK), n_actions)))))
    return F.when(prompt_only, user).otherwise(F.concat(user, answer))


def image_names(names: Column) -> Column:
    """Names of image members in lexicographic order, so that image_10 comes before image_2. Their pattern."""
    return F.array_sort(F.filter(names, lambda x: x.startswith("image_") & x.endswith(".jpg")))


def messages(question: Column, answer: Column, prompt_only: Column) -> Column:
    """User and assistant turns; prompts alone have no answer."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = F.array(turn("user", question))
    return F.when(prompt_only, user).otherwise(F.concat(user, F.array(turn("assistant", answer))))


def as_json(fields: dict[str, Column], drop: Sequence[str] = ()) -> Column:
    """A request's fields as JSON: binary as hex, all but the dropped ones (images and depths)."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items() if k not in drop)))


def stamp(ts: Column) -> Column:
    """ISO time with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def intrinsic_vector(k: Column) -> Column:
    """fx, fy, cx, cy of a flat 3x3 matrix; shorter arrays stay."""
    return F.when(F.size(k) == 9, F.array(F.get(k, 0), F.get(k, 4), F.get(k, 2), F.get(k, 5))).otherwise(k)
