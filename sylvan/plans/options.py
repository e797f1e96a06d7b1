"""Settings of a fit as command-line options: listing, parsing, writing."""

from __future__ import annotations

from ..operators.tree import Options

#: The options' letters, with the setting, the type (none: a flag, with the value it sets) and the meaning.
OPTIONS = [
    ("-U", "unpruned", None, True, "unpruned tree"),
    ("-O", "collapse", None, False, "do not collapse the tree"),
    ("-C", "confidence", float, None, "confidence for pruning, between 0 and 1"),
    ("-M", "least", int, None, "least rows of a leaf"),
    ("-R", "reduced_error", None, True, "reduced-error pruning"),
    ("-N", "folds", int, None, "folds for reduced-error pruning, one of them held back"),
    ("-B", "binary", None, True, "binary splits only"),
    ("-S", "raising", None, False, "no subtree raising"),
    ("-A", "laplace", None, True, "Laplace smoothing of probabilities"),
    ("-J", "mdl", None, False, "no charge on numeric splits for the number of thresholds"),
    ("-Q", "seed", int, None, "seed"),
    ("-Z", "gain_pruning", None, True, "let the best static split's gain bound the pattern search"),
    ("-SP", "relocate", None, False, "do not move thresholds to values of the table"),
    ("-P", "support", float, None, "least share of sequences that a pattern matches"),
    ("-G", "gap", int, None, "most distance of two itemsets of a pattern"),
    ("-I", "longest", int, None, "most items of a pattern"),
    ("-W", "pattern_weight", float, None, "weight of gain against length or complexity"),
    ("-POP", "population", int, None, "shapelets of a generation"),
    ("-EV", "evaluations", int, None, "shapelets that are evaluated"),
    ("-CR", "crossover", float, None, "chance of crossover"),
    ("-MUT", "mutation", float, None, "chance of mutation"),
]


def listing() -> str:
    """One line an option, with its default."""
    default = Options()
    return "\n".join(f"{flag + (' <value>' if kind else ''):<14}{text}" + (f" (default {getattr(default, name)})" if kind else "") for flag, name, kind, _, text in OPTIONS)


def parse(args: list[str]) -> Options:
    """Options from their flags; one that is unknown, repeated, without its value or at odds with another raises ValueError."""
    by_flag = {flag: (name, kind, value) for flag, name, kind, value, _ in OPTIONS}
    given: dict[str, object] = {}
    left = list(args)
    while left:
        flag = left.pop(0)
        if flag not in by_flag:
            raise ValueError(f"no option {flag}")
        name, kind, value = by_flag[flag]
        if name in given:
            raise ValueError(f"{flag} is given twice")
        if kind:
            if not left:
                raise ValueError(f"{flag} takes a value")
            value = kind(left.pop(0))
        given[name] = value
    if "confidence" in given and ("reduced_error" in given or "unpruned" in given):
        raise ValueError("-C has no meaning with -R or -U")
    if "folds" in given and "reduced_error" not in given:
        raise ValueError("-N has no meaning without -R")
    return Options(**given)


def emit(o: Options) -> list[str]:
    """The options that parse() turns into ``o``; those that have no meaning beside others are left out."""
    skip = {"confidence"} if o.unpruned or o.reduced_error else set()
    skip |= set() if o.reduced_error else {"folds"}
    out = []
    for flag, name, kind, value, _ in OPTIONS:
        now = getattr(o, name)
        if kind and name not in skip:
            out += [flag, str(kind(now))]
        elif not kind and now == value:
            out.append(flag)
    return out
