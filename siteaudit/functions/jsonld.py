"""JSON-LD blocks: typed nodes, validity, and missing properties."""

from __future__ import annotations

import json
import re

_ARTICLE = ("headline", "image", "author", "datePublished", "dateModified", "publisher")
# Required and recommended properties by type.
SPECS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Article": ((), _ARTICLE),
    "BlogPosting": ((), _ARTICLE),
    "NewsArticle": ((), _ARTICLE),
    "Product": (("name", "image"), ("description", "brand", "sku", "offers", "aggregateRating", "review")),
    "Offer": (("price", "priceCurrency"), ("availability", "url", "priceValidUntil")),
    "Recipe": (("name", "image"), ("recipeIngredient", "recipeInstructions", "author", "datePublished", "aggregateRating", "prepTime", "cookTime", "nutrition")),
    "Event": (("name", "startDate", "location"), ("endDate", "image", "description", "offers", "performer", "organizer")),
    "JobPosting": (("title", "description", "datePosted", "hiringOrganization", "jobLocation"), ("baseSalary", "employmentType", "validThrough")),
    "FAQPage": (("mainEntity",), ()),
    "QAPage": (("mainEntity",), ()),
    "BreadcrumbList": (("itemListElement",), ()),
    "HowTo": (("name", "step"), ("image", "totalTime", "supply", "tool")),
    "VideoObject": (("name", "description", "thumbnailUrl", "uploadDate"), ("duration", "contentUrl", "embedUrl")),
    "Organization": ((), ("name", "url", "logo", "sameAs", "contactPoint")),
    "LocalBusiness": (("name", "address"), ("telephone", "openingHours", "geo", "priceRange", "image", "url")),
    "Review": (("itemReviewed", "reviewRating", "author"), ("datePublished", "publisher")),
    "AggregateRating": (("ratingValue",), ("bestRating", "worstRating")),
    "Person": ((), ("name", "url")),
    "WebSite": ((), ("name", "url")),
}
#: Types of which one of several properties must be there.
ONE_OF = {"Product": ("offers", "review", "aggregateRating"), "AggregateRating": ("ratingCount", "reviewCount")}
_BY_NAME = {k.lower(): v for k, v in SPECS.items()}
FAQ_TYPES = ("FAQPage", "QAPage", "Question")


def present(value: object) -> bool:
    """Neither null, blank nor empty; any number or boolean is present."""
    if value is None:
        return False
    if isinstance(value, str):
        return bool(value.strip())
    return bool(value) if isinstance(value, (list, dict)) else True


def _strict(text: str) -> object:
    def no(token: str) -> object:
        raise ValueError(token)

    return json.loads(text, parse_constant=no)


def typed_nodes(value: object) -> list[tuple[str, dict]]:
    """(type, node) of all nodes with a type, parents first, keys in sorted order."""
    out: list[tuple[str, dict]] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            kinds = v.get("@type")
            out += [(k, v) for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
            stack += [v[k] for k in sorted(v, reverse=True)]
    return out


def missing(kind: str, node: dict) -> tuple[list[str], list[str]]:
    """Required and recommended properties that a node of a known type lacks."""
    required, recommended = _BY_NAME.get(kind.lower(), ((), ()))
    lacks = [p for p in required if not present(node.get(p))]
    if kind in ONE_OF and not any(present(node.get(p)) for p in ONE_OF[kind]):
        lacks.append("|".join(ONE_OF[kind]))
    return lacks, [p for p in recommended if not present(node.get(p))]


def validate(blocks: list[str]) -> tuple[list[str], list[dict], int]:
    """Types in first-seen order, items that lack something, and the number of invalid blocks."""
    types: list[str] = []
    items: list[dict] = []
    invalid = 0
    for block in blocks:
        if not block.strip():
            continue
        try:
            value = _strict(block)
        except (ValueError, RecursionError):
            invalid += 1
            types += re.findall(r'"@type"\s*:\s*"([^"]+)"', block)
            continue
        for kind, node in typed_nodes(value):
            types.append(kind)
            required, recommended = missing(kind, node)
            if required or recommended:
                items.append({"type_name": kind, "missing_required": required, "missing_recommended": recommended})
    return list(dict.fromkeys(types)), items, invalid
