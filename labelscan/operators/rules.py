"""Declaration rules as column expressions.

A :class:`Rule` is data: an applicability condition and an ordered list of
branches.  ``Suite`` turns a list of rules into one integer ``CASE`` per rule and lookups on
it, so the whole suite is a projection over the product table, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.functions.text import (
    blank, contains_any, empty, has, has_digit, has_letter, quantity_category, strip,
)

PRODUCT_COLUMNS = {
    # target field of the rules -> column of the product table
    "productId": "product_id", "productName": "product_name", "productType": "product_type",
    "isImported": "is_imported", "manufacturerName": "manufacturer_name",
    "manufacturerAddress": "manufacturer_address", "packerName": "packer_name",
    "importerName": "importer_name", "netQuantity": "net_quantity", "mrp": "mrp",
    "monthOfPacking": "month_of_packing", "yearOfPacking": "year_of_packing",
    "consumerCare": "consumer_care", "countryOfOrigin": "country_of_origin",
    "unitSalePrice": "unit_sale_price", "expiryDate": "expiry_date",
    "fontSizeMm": "font_size_mm", "principalDisplayAreaCm2": "principal_display_area_cm2",
    "declarationPlacement": "declaration_placement",
    "isPDPPlacementValid": "is_pdp_placement_valid", "contrastRatio": "contrast_ratio",
    "isLegible": "is_legible",
}


@dataclass(frozen=True)
class Branch:
    """First true ``when`` decides. ``severity`` None means the rule's own."""

    when: Callable[[], Column]
    status: str
    message: Callable[[], Column] | str
    severity: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    branches: tuple[Branch, ...] = ()
    severity: str = "HIGH"
    target: str | None = None
    hint: str | None = None
    applicable: Callable[[], Column] = field(default=lambda: F.lit(True))
    # optional replacement of the branches: a column (for example a pandas UDF)
    # that returns struct<status,severity,message>
    custom: Callable[[], Column] | None = None

    def decision(self, offset: int) -> Column:
        """Branch number within the suite: ``offset`` when the rule does not apply,
        ``offset + n`` when its n-th branch decides."""
        chain = F.when(~F.coalesce(self.applicable(), F.lit(False)), F.lit(offset))
        if self.custom is not None:
            return chain.otherwise(F.lit(offset + 1))
        for i, b in enumerate(self.branches, start=1):
            chain = chain.when(b.when(), F.lit(offset + i))
        return chain

    @property
    def skip_message(self) -> str:
        return f"Rule '{self.rule_id}' is not applicable for this product configuration."


class Suite:
    """Lookup tables of a list of rules.

    All branches of all rules are numbered through.  A product row then carries one
    small integer per rule, and status, severity and message are array lookups on
    it, so the generated code stays short however many rules there are.
    """

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)
        self.offsets: list[int] = []
        status, severity, message = [], [], []
        self.quoted: dict[int, Callable[[], Column]] = {}
        self.custom: dict[int, Callable[[], Column]] = {}
        for r in self.rules:
            self.offsets.append(len(status))
            status.append(V.NOT_APPLICABLE)
            severity.append(r.severity)
            message.append(r.skip_message)
            if r.custom is not None:
                self.custom[len(status)] = r.custom
                status.append("")
                severity.append("")
                message.append("")
                continue
            for b in r.branches:
                if not isinstance(b.message, str):
                    self.quoted[len(status)] = b.message
                default = "MEDIUM" if b.status == V.MANUAL_REVIEW else r.severity
                status.append(b.status)
                severity.append(b.severity or default)
                message.append(b.message if isinstance(b.message, str) else "")
        self._status, self._severity, self._message = status, severity, message

    @staticmethod
    def _pick(values: list[str], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)

    def codes(self) -> Column:
        """``array<int>``: the deciding branch of every rule, in rule order."""
        return F.array(*[r.decision(o) for r, o in zip(self.rules, self.offsets)])

    def of_rule(self, attribute: Callable[[Rule], str], pos: Column) -> Column:
        """A constant of the rule at 0-based position ``pos``."""
        return self._pick([attribute(r) for r in self.rules], pos)

    def custom_columns(self) -> list[Column]:
        """The results of custom rules, as columns that the lookups refer to."""
        return [make().alias(f"custom_{at}") for at, make in self.custom.items()]

    def _with_custom(self, out: Column, code: Column, name: str) -> Column:
        for at in self.custom:
            out = F.when(code == at, F.col(f"custom_{at}").getField(name)).otherwise(out)
        return out

    def status(self, code: Column) -> Column:
        return self._with_custom(self._pick(self._status, code), code, "status")

    def severity(self, code: Column) -> Column:
        return self._with_custom(self._pick(self._severity, code), code, "severity")

    def message(self, code: Column) -> Column:
        out = self._pick(self._message, code)
        for at, make in self.quoted.items():
            out = F.when(code == at, make()).otherwise(out)
        return self._with_custom(out, code, "message")


class RuleRegistry:
    """Ordered set of rules; registering an id twice keeps the first."""

    def __init__(self, rules: list[Rule] | None = None):
        self._rules: dict[str, Rule] = {}
        for r in rules or []:
            self.register(r)

    def register(self, rule: Rule) -> Rule:
        self._rules.setdefault(rule.rule_id, rule)
        return rule

    def all(self) -> list[Rule]:
        return list(self._rules.values())

    def clear(self) -> None:
        self._rules.clear()


def _c(target: str) -> Column:
    return F.col(PRODUCT_COLUMNS[target])


def _always() -> Column:
    return F.lit(True)


def _missing(*targets: str) -> Callable[[], Column]:
    """All of the fields are blank."""

    def cond():
        out = F.lit(True)
        for t in targets:
            out = out & blank(_c(t))
        return out

    return cond


def _given(target: str) -> Callable[[], Column]:
    return lambda: ~blank(_c(target))


def _quote(before: str, value: Callable[[], Column], after: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(before), F.coalesce(value(), F.lit("None")), F.lit(after))


def _stripped(target: str) -> Callable[[], Column]:
    return lambda: strip(_c(target))


def _any_pattern(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | has(c, p)
    return out


def _imported() -> Column:
    return F.coalesce(_c("isImported"), F.lit(False))


def _usp_snippet() -> Column:
    """The first unit-price text inside the MRP field."""
    hits = [F.nullif(F.regexp_extract(strip(_c("mrp")), p, 0), F.lit("")) for p in V.UNIT_PRICE_PATTERNS]
    return F.coalesce(*hits)


def _perishable() -> Column:
    kind = F.lower(strip(F.coalesce(_c("productType"), F.lit(""))))
    return kind.isin(V.PERISHABLE_TYPES)


def _one_decimal(target: str) -> Callable[[], Column]:
    return lambda: F.format_string("%.1f", _c(target))


# --- fixed values: rule ids, names, hints and messages ---------------------------------
MRP = Rule(
    "LM-RULE-MRP-001", "Maximum Retail Price (MRP) Declaration Check", severity="CRITICAL",
    target="mrp",
    hint="Declare MRP in statutory format: 'MRP Rs. XX.XX (incl. of all taxes)' or '₹ XX.XX (incl. of all taxes)'",
    branches=(
        Branch(_missing("mrp"), V.FAIL, "MRP declaration is completely missing from product payload."),
        Branch(lambda: ~has_digit(_c("mrp")), V.FAIL,
               "MRP declaration does not contain a valid numeric price value."),
        Branch(lambda: contains_any(F.lower(_c("mrp")), V.TAX_CLAUSES), V.PASS,
               "MRP value, currency representation, and tax inclusion phrase ('incl. of all taxes') are clearly declared."),
        Branch(_always, V.MANUAL_REVIEW,
               "Numeric MRP value is present, but statutory presentation details and tax inclusion clause ('incl. of all taxes') cannot be verified from structured input."),
    ),
)

NET_QUANTITY = Rule(
    "LM-RULE-NETQTY-002", "Net Quantity Declaration Check", target="netQuantity",
    hint="Declare Net Quantity in standard metric units (Weight: g/kg, Volume: ml/L, Length: m/cm, Area: sq m, Number: N/count).",
    branches=(
        Branch(_missing("netQuantity"), V.FAIL,
               "Net Quantity declaration is completely missing from product payload."),
        Branch(lambda: ~has_digit(_c("netQuantity")), V.FAIL,
               "Net Quantity declaration lacks a valid numeric quantity value."),
        Branch(lambda: quantity_category(_c("netQuantity")).isNotNull(), V.PASS,
               _quote("Net Quantity declaration is present in valid statutory metric units (Category: ",
                      lambda: quantity_category(_c("netQuantity")), ").")),
        Branch(_always, V.MANUAL_REVIEW,
               "Net Quantity numeric value present, but unit category alignment requires physical label verification."),
    ),
)

IMPORTER = Rule(
    "LM-RULE-IMP-003", "Importer Name & Address Check for Foreign Commodities", severity="CRITICAL",
    target="importerName",
    hint="Declare name and complete Indian office address of the Importer on imported package labels.",
    applicable=lambda: F.coalesce(_c("isImported"), F.lit(True)),
    branches=(
        Branch(lambda: _c("isImported").isNull(), V.MANUAL_REVIEW,
               "Import status is unconfirmed in structured payload; manual review required to determine if commodity is imported."),
        Branch(_missing("importerName"), V.FAIL,
               "Mandatory Importer name and address declaration is missing on imported package."),
        Branch(_always, V.PASS, "Importer declaration is present on imported package."),
    ),
)

PRODUCT_NAME = Rule(
    "LM-RULE-NAME-004", "Generic / Commodity Name Declaration Check", target="productName",
    hint="Declare the generic or common name of the commodity on the principal display panel.",
    branches=(
        Branch(_missing("productName"), V.FAIL,
               "Generic or common name of the commodity is completely missing from product payload."),
        Branch(lambda: (F.length(strip(_c("productName"))) < 2) | ~has_letter(_c("productName")),
               V.MANUAL_REVIEW,
               "Declared commodity name appears vague or numerical; manual label verification required."),
        Branch(_always, V.PASS, "Generic or common name of commodity is declared."),
    ),
)

MAKER_NAME = Rule(
    "LM-RULE-MFGNAME-005", "Manufacturer or Packer Name Declaration Check", severity="CRITICAL",
    target="manufacturerName",
    hint="Declare the name of the Manufacturer or Packer clearly on the package label.",
    applicable=lambda: ~(_imported() & empty(_c("manufacturerName")) & empty(_c("packerName"))),
    branches=(
        Branch(_missing("manufacturerName", "packerName"), V.FAIL,
               "Name of Manufacturer or Packer is completely missing from product payload."),
        Branch(_always, V.PASS,
               "Manufacturer or Packer name declaration is present in structured payload."),
    ),
)

MAKER_ADDRESS = Rule(
    "LM-RULE-MFGADDR-006", "Manufacturer or Packer Address Declaration Check",
    target="manufacturerAddress",
    hint="Declare complete address of Manufacturer/Packer (premises, city, state, 6-digit pincode) on package label.",
    applicable=lambda: ~(
        _imported() & empty(_c("manufacturerName")) & empty(_c("packerName"))
        & empty(_c("manufacturerAddress"))
    ),
    branches=(
        Branch(_missing("manufacturerAddress"), V.FAIL,
               "Manufacturer or Packer address declaration is completely missing from product payload."),
        Branch(lambda: has(strip(_c("manufacturerAddress")), V.PINCODE), V.PASS,
               "Manufacturer or Packer address text is present with 6-digit pincode."),
        Branch(_always, V.MANUAL_REVIEW,
               "Manufacturer or Packer address text is present, but missing 6-digit pincode; manual verification required."),
    ),
)

PACKING_DATE = Rule(
    "LM-RULE-DATE-007", "Month and Year of Packing / Manufacture Check", target="monthOfPacking",
    hint="Declare Month and Year of packing/manufacture in standard format (e.g., '07/2026' or 'July 2026').",
    branches=(
        Branch(_missing("monthOfPacking", "yearOfPacking"), V.FAIL,
               "Month and Year of packing or manufacture is completely missing."),
        Branch(lambda: blank(_c("monthOfPacking")) | blank(_c("yearOfPacking")), V.FAIL,
               "Incomplete date declaration; both Month AND Year of packing/manufacture are required."),
        Branch(lambda: ~F.lower(strip(_c("monthOfPacking"))).isin(V.VALID_MONTHS), V.MANUAL_REVIEW,
               _quote("Month value '", _stripped("monthOfPacking"),
                      "' is non-standard; manual label verification required.")),
        Branch(lambda: ~has(strip(_c("yearOfPacking")), f"^(?:{V.DIGIT_CLASS}{{2}}|{V.DIGIT_CLASS}{{4}})$"),
               V.MANUAL_REVIEW,
               _quote("Year value '", _stripped("yearOfPacking"),
                      "' is non-standard; manual label verification required.")),
        Branch(_always, V.PASS,
               "Month and Year of packing/manufacture declaration is present in standard format."),
    ),
)

CONSUMER_CARE = Rule(
    "LM-RULE-CARE-008", "Consumer Care Details Declaration Check", target="consumerCare",
    hint="Declare name, complete address, telephone number, and email address of the Consumer Care officer/office.",
    branches=(
        Branch(_missing("consumerCare"), V.FAIL,
               "Consumer care contact details are completely missing from product payload."),
        Branch(lambda: contains_any(F.lower(_c("consumerCare")), ["@", "email", "tel", "phone", "call"])
               | has_digit(_c("consumerCare")), V.PASS,
               "Consumer care contact details (phone/email/address) are declared."),
        Branch(_always, V.MANUAL_REVIEW,
               "Consumer care details provided but lack clear telephone/email contact format; manual verification required."),
    ),
)

ORIGIN = Rule(
    "LM-RULE-COO-009", "Country of Origin Declaration Check", severity="CRITICAL",
    target="countryOfOrigin",
    hint="Declare Country of Origin (e.g., 'Country of Origin: India' or 'Made in India') prominently on package labels.",
    applicable=lambda: _imported() | ~blank(_c("countryOfOrigin")),
    branches=(
        Branch(lambda: blank(_c("countryOfOrigin")) & _imported(), V.FAIL,
               "Mandatory Country of Origin declaration is missing on imported package."),
        Branch(_given("countryOfOrigin"), V.PASS,
               _quote("Country of Origin declaration is present: '", _stripped("countryOfOrigin"), "'.")),
        Branch(_always, V.MANUAL_REVIEW, "Country of Origin detail requires manual label review.", "LOW"),
    ),
)

UNIT_PRICE = Rule(
    "LM-RULE-USP-010", "Unit Sale Price (USP) Declaration Check", target="unitSalePrice",
    hint="Declare Unit Sale Price in standard format (e.g. 'Rs. 0.50 / g' or '₹200.00 / kg') alongside MRP on package labels.",
    applicable=lambda: ~blank(_c("unitSalePrice")) | _any_pattern(_c("mrp"), V.UNIT_PRICE_PATTERNS)
    | has(_c("netQuantity"), r"(?U)\d"),
    branches=(
        Branch(lambda: ~blank(_c("unitSalePrice"))
               & _any_pattern(strip(_c("unitSalePrice")), V.UNIT_PRICE_PATTERNS), V.PASS,
               _quote("Unit Sale Price declaration is present: '", _stripped("unitSalePrice"), "'.")),
        Branch(_given("unitSalePrice"), V.MANUAL_REVIEW,
               _quote("Unit Sale Price text '", _stripped("unitSalePrice"),
                      "' is non-standard; manual label verification required.")),
        Branch(lambda: _any_pattern(strip(_c("mrp")), V.UNIT_PRICE_PATTERNS), V.PASS,
               _quote("Unit Sale Price detected in price snippet: '", _usp_snippet, "'.")),
        Branch(_given("netQuantity"), V.MANUAL_REVIEW,
               "Unit Sale Price declaration is missing; manual verification required to check applicability under Rule 6(11)."),
        Branch(_always, V.MANUAL_REVIEW,
               "Unit Sale Price declaration is missing and net quantity is unprovided.", "LOW"),
    ),
)

EXPIRY = Rule(
    "LM-RULE-EXP-011", "Best Before / Expiry Date Declaration Check", target="expiryDate",
    hint="Declare 'Best Before' period or 'Expiry Date' (e.g. 'Best Before 12 Months from Mfd' or 'Exp: 12/2027') on perishable package labels.",
    applicable=lambda: _perishable() | ~blank(_c("expiryDate")),
    branches=(
        Branch(lambda: ~blank(_c("expiryDate")) & _any_pattern(strip(_c("expiryDate")), V.EXPIRY_PATTERNS),
               V.PASS,
               _quote("Expiry / Best Before declaration is present: '", _stripped("expiryDate"), "'.")),
        Branch(_given("expiryDate"), V.MANUAL_REVIEW,
               _quote("Expiry / Best Before text '", _stripped("expiryDate"),
                      "' is non-standard; manual label verification required.")),
        Branch(_perishable, V.FAIL,
               _quote("Mandatory Best Before / Expiry Date declaration is missing for perishable category '",
                      lambda: _c("productType"), "'.")),
        Branch(_given("productType"), V.NOT_APPLICABLE,
               "Expiry date declaration is not mandatory for non-perishable commodity."),
        Branch(_always, V.MANUAL_REVIEW,
               "Expiry date declaration is not present; verify if commodity is non-perishable."),
    ),
)

FONT_HEIGHT = Rule(
    "LM-RULE-FONT-012", "Font Size & Readability Analysis Check", target="fontSizeMm",
    hint="Ensure font height of mandatory declarations meets minimum statutory millimeter requirements under Rule 7 & 9.",
    applicable=lambda: _c("fontSizeMm").isNotNull(),
    branches=(
        Branch(lambda: _c("fontSizeMm") < V.MIN_FONT_MM, V.FAIL,
               _quote("Measured declaration font height (", _one_decimal("fontSizeMm"),
                      f" mm) is below absolute statutory minimum requirement of {V.MIN_FONT_MM:.1f} mm.")),
        Branch(_always, V.PASS,
               _quote("Declaration font size measurement (", _one_decimal("fontSizeMm"),
                      " mm) satisfies statutory legibility requirements.")),
    ),
)

PLACEMENT = Rule(
    "LM-RULE-PLACE-013", "Declaration Placement & PDP Panel Check", target="declarationPlacement",
    hint="Ensure all mandatory statutory declarations are grouped together and prominently displayed on the Principal Display Panel (PDP).",
    applicable=lambda: ~blank(_c("declarationPlacement")) | _c("isPDPPlacementValid").isNotNull(),
    branches=(
        Branch(lambda: F.coalesce(_c("isPDPPlacementValid"), F.lit(False)), V.PASS,
               "Mandatory declarations are properly placed on the Principal Display Panel (PDP)."),
        Branch(lambda: F.coalesce(~_c("isPDPPlacementValid"), F.lit(False)), V.FAIL,
               "Mandatory declarations are placed outside the statutory Principal Display Panel."),
        Branch(lambda: contains_any(F.upper(_c("declarationPlacement")), V.PANEL_WORDS), V.PASS,
               _quote("Declaration placement area '", lambda: _c("declarationPlacement"),
                      "' satisfies Principal Display Panel requirements.")),
        Branch(_always, V.MANUAL_REVIEW,
               _quote("Declaration placement location '", lambda: _c("declarationPlacement"),
                      "' requires manual label verification for PDP compliance.")),
    ),
)

READABILITY = Rule(
    "LM-RULE-READ-014", "Physical Legibility & Color Contrast Check", target="contrastRatio",
    hint="Ensure label text has adequate color contrast against background packaging for legibility under Rule 8.",
    applicable=lambda: _c("contrastRatio").isNotNull() | _c("isLegible").isNotNull(),
    branches=(
        Branch(lambda: F.coalesce(~_c("isLegible"), F.lit(False)), V.FAIL,
               "Label text legibility does not meet statutory standards under Rule 8."),
        Branch(lambda: _c("contrastRatio") >= V.CONTRAST_GOOD, V.PASS,
               _quote("Text contrast ratio (", lambda: _c("contrastRatio").cast("string"),
                      ":1) meets statutory legibility standards.")),
        Branch(lambda: _c("contrastRatio") < V.CONTRAST_BAD, V.FAIL,
               _quote("Text contrast ratio (", lambda: _c("contrastRatio").cast("string"),
                      ":1) is insufficient for legibility under Rule 8.")),
        Branch(lambda: _c("contrastRatio").isNotNull(), V.MANUAL_REVIEW,
               _quote("Text contrast ratio (", lambda: _c("contrastRatio").cast("string"),
                      ":1) requires manual verification.")),
        Branch(_always, V.PASS, "Visual legibility and contrast meet statutory standards."),
    ),
)

ALL_RULES = [
    MRP, NET_QUANTITY, IMPORTER, PRODUCT_NAME, MAKER_NAME, MAKER_ADDRESS, PACKING_DATE,
    CONSUMER_CARE, ORIGIN, UNIT_PRICE, EXPIRY, FONT_HEIGHT, PLACEMENT, READABILITY,
]


def default_registry() -> RuleRegistry:
    return RuleRegistry(ALL_RULES)
