"""An invented rulebook of an allotment garden scheme, with an amendment, findings, contacts, a timeline and cases."""

MANUAL = """# Garden Plot Scheme Rules

Consolidated text as at 5 January 2026

## Part 1 — Plots

### 1.1 Plots and holders

**1.1.1 Plot** A plot is land let to one holder for growing.

**1.1.2** A person is eligible for a plot where the person lives in the parish and is aged 18 or over.

**1.1.3** A person who holds another plot is not eligible for a second plot.

### 1.2 Waiting list

**1.2.1** The clerk must keep a waiting list. An applicant may join the list by post or online.

**1.2.2** An applicant must accept an offered plot within 14 calendar days, as §1.2.1 and §1.9 describe.

**1.2.3** The following evidence is accepted:

(a) a lease;
(b) a bill; or
(c) a letter “from the parish”.

---

## Part 2 — Rent and water

### 2.1 Rent

**2.1.1** The yearly rent is $120 for each plot.

**2.1.2** Rent must be paid within 30 calendar days of the invoice.

**2.1.3** A holder of less than one month must pay rent within 10 calendar days of the invoice, see §2.1.2.

### 2.2 Water

| Size | Allowance |
|---|---|
| small | 2 hours |

**2.2.1** The water table is:

| Size | Weekly allowance |
|---|---|
| small | 2 hours |
| large | 4 hours |

**2.2.2** Hoses must not be used at night.

**2.2.3** Hoses must be used with a meter.

## Part 3 — Disputes

### 3.1 Right of appeal

**3.1.1** A holder may appeal a decision within 21 calendar days. `Forms` are kept by the clerk.

**3.1.2** The appeal period is extended to 42 days where the holder was ill.

### 3.2 Sheds

**3.2.1** Sheds may be up to 3 metres long.

**3.2.2** Hoses must not be used at night.
"""

AMENDMENT = """## Amendment No. 1

**Issued:** 10 February 2026

**Effective:** 1 March 2026

## 1. Rent

**1.1** In §2.1.1 substitute "$150" for "$120".

**1.2** After §2.1.3 insert:

> **2.1.3A** A holder aged 70 or over pays half the rent.

## 5. Transition

**5.1** The rent in force on the date of the determination applies.
"""

FINDINGS = {
    "document_id": "rules", "document_name": "rules.md", "document_version": "5 January 2026", "consolidated_as_of": "2026-01-05", "source_verified": True,
    "reviewed_amendments": [{"document_id": "amendment-1", "amendment_number": "1", "effective_date": "2026-03-01", "source_verified": True}],
    "conflicts": [{"id": "rent-deadline", "status": "open", "clause_ids": ["2.1.2", "2.1.3"], "topic_terms": ["rent deadline new holder"], "trigger_patterns": ["rent.*(30|10) days"], "explanation": "Two deadlines for rent.", "source_verified": True}],
    "gaps": [{"id": "beehives", "status": "open", "clause_ids": ["3.2.1"], "topic_terms": ["bee hives"], "trigger_patterns": ["\\\\bbee"], "explanation": "The rules are silent on bees.", "source_verified": True}],
}
FINDINGS["gaps"][0]["trigger_patterns"] = [r"\bbee"]
CONTACTS = {k: {"next_step": f"Ask the {w}.", "source_clause_ids": ["1.2.1"]} for k, w in {"default": "clerk", "eligibility": "list keeper", "appeals": "panel", "conflict": "chair"}.items()}
TIMELINE = {
    "schema_version": 1, "source_verified": True, "manual_document_id": "rules", "amendment_document_id": "amendment-1", "amendment_number": "1", "effective_date": "2026-03-01", "issued_date": "2026-02-10",
    "rules": [{"id": "rent", "topic": "rent", "operation": "substitute", "target_clause_ids": ["2.1.1"], "amendment_paragraph_id": "1.1", "transition_paragraph_id": "5.1", "temporal_basis": "determination_date", "before": {"yearly": 120}, "after": {"yearly": 150}, "expected_replacement_count": 1, "source_verified": True}],
}
TOPICS = (("rent", r"(?i)\b(how much|yearly|amount).{0,30}\brent\b|\brent\b.{0,20}\bdetermin"),)


def write(folder):
    """All files under a folder; their paths by name."""
    import json

    texts = {"rules.md": MANUAL, "amendment-1.md": AMENDMENT, "findings.json": json.dumps(FINDINGS), "contacts.json": json.dumps(CONTACTS), "timeline.json": json.dumps(TIMELINE)}
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf-8")
    return {n: str(folder / n) for n in texts}
