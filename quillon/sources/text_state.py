"""The text state of a content stream: which glyphs are shown where. Sequential by nature, so one fold per stream."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .syntax import instructions, number

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


@dataclass(frozen=True)
class Font:
    """bytes_per_code, texts and widths (thousandths) by code, the width of codes without one."""

    bytes_per_code: int = 1
    texts: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 500.0


@dataclass(frozen=True)
class State:
    ctm: Matrix = UNIT
    fill: tuple | None = (0.0, 0.0, 0.0)
    font: str = ""
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


#: Operators that set one number: the field and what the number is multiplied by.
_SETTERS = {"Tc": ("char", 1.0), "Tw": ("word", 1.0), "Tz": ("scale", 0.01), "TL": ("leading", 1.0), "Ts": ("rise", 1.0), "Tr": ("mode", 1)}


def _colour(numbers: list[float]) -> tuple | None:
    if len(numbers) == 1:
        return (numbers[0],) * 3
    if len(numbers) == 3:
        return tuple(numbers)
    if len(numbers) == 4:
        return tuple((1 - c) * (1 - numbers[3]) for c in numbers[:3])
    return None


def glyphs(data: bytes, fonts: dict[str, Font], base: Matrix = UNIT) -> list[dict]:
    """One row per glyph: op_index, elem_index, byte_start, code, text, x0, x1, y0, size, font, fill, segment.

    segment counts what parts runs whatever the geometry says: another font, spacing, mode, colour, text object.
    """
    state, saved = State(ctm=base), []
    text_matrix = line_matrix = UNIT
    rows: list[dict] = []
    segment = 0
    for op_index, (op, args, _, _) in enumerate(instructions(data)):
        nums = [number(a) for a in args]
        if op == "q":
            saved.append(state)
        elif op == "Q":
            state = saved.pop() if saved else state
            segment += 1
        elif op == "cm" and len(nums) >= 6:
            state = replace(state, ctm=product(tuple(nums[:6]), state.ctm))
        elif op in ("g", "rg", "k", "sc", "scn"):
            fill = _colour([number(a) for a in args if isinstance(a, int | float)])
            segment += fill != state.fill
            state = replace(state, fill=fill)
        elif op in ("BT", "ET", "Do"):
            segment += 1
            if op == "BT":
                text_matrix = line_matrix = UNIT
        elif op == "Tf" and len(args) >= 2:
            state, segment = replace(state, font=str(args[0]), size=nums[1]), segment + 1
        elif op in _SETTERS and nums:
            name, factor = _SETTERS[op]
            state = replace(state, **{name: type(factor)(nums[0] * factor)})
            segment += op != "TL"
        elif op == "Tm" and len(nums) >= 6:
            text_matrix = line_matrix = tuple(nums[:6])
        elif op in ("Td", "TD", "T*", "'", '"') :
            if op == '"' and len(nums) >= 3:
                state = replace(state, word=nums[0], char=nums[1])
            if op == "TD" and len(nums) >= 2:
                state = replace(state, leading=-nums[1])
            if op in ("Td", "TD") and len(nums) < 2:
                continue
            move = (nums[0], nums[1]) if op in ("Td", "TD") else (0.0, -state.leading)
            text_matrix = line_matrix = product((1.0, 0.0, 0.0, 1.0, *move), line_matrix)
        if op in ("Tj", "TJ", "'", '"') and args:
            font = fonts.get(state.font)
            for elem, item in enumerate(args[0] if op == "TJ" and isinstance(args[0], list) else [args[-1]]):
                if isinstance(item, int | float):
                    text_matrix = product((1.0, 0.0, 0.0, 1.0, -item / 1000 * state.size * state.scale, 0.0), text_matrix)
                    continue
                if font is None or not isinstance(item, bytes):
                    continue
                step = font.bytes_per_code
                for at in range(0, len(item) - step + 1, step):
                    code = int.from_bytes(item[at : at + step], "big")
                    shown = product((state.size * state.scale, 0.0, 0.0, state.size, 0.0, state.rise), product(text_matrix, state.ctm))
                    width = font.widths.get(code, font.default_width) / 1000
                    pen = (width * state.size + state.char + (state.word if step == 1 and code == 32 else 0.0)) * state.scale
                    rows.append(
                        {"op_index": op_index, "elem_index": elem, "byte_start": at, "code": code, "text": font.texts.get(code, ""), "x0": shown[4], "x1": shown[4] + width * shown[0], "y0": shown[5], "size": abs(shown[3]), "font": state.font, "fill": state.fill, "segment": segment}
                    )
                    text_matrix = product((1.0, 0.0, 0.0, 1.0, pen, 0.0), text_matrix)
    return rows
