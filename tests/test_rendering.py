from stratal import rendering as r
from stratal.facade import ConfirmationNeeded, confirm_token
from stratal.operators.mutations import NotFound
from stratal.plans import model as m
from stratal.plans.constraints import SelectionNotFound


def test_lines_headers_and_errors():
    a = m.make("SubClassOf", (("rdfs:comment", m.Literal("x", None, "en")),), sub_class="ex:A", super_class="ex:B")
    assert r.axiom_line("ab" * 32, a, {"ex:A": "Alpha"}) == "abababababab  SubClassOf(ex:A, ex:B)  [ex:A = 'Alpha']\n    rdfs:comment \"x\"@en"
    assert r.plural(1, "axiom") == "1 axiom" and r.plural(1200, "entity") == "1,200 entities"
    assert r.drift_header("s", "entity", 3, 2) == "s: 3 entities, 1 missing"
    assert r.paging_header(10, 5, 100) == "Showing 11-15 of 100"
    assert r.diff((("+", str(i)) for i in range(30)), 30).endswith("... 10 more")
    assert r.error_text(SelectionNotFound("x")) == "Selection not found: x" and r.error_text(NotFound("h")) == "Not found: h"
    assert confirm_token("a", 1) in r.error_text(ConfirmationNeeded("go", confirm_token("a", 1)))
    assert r.error_text(m.ModelError("bad")) == "Invalid input: bad" and r.error_text(ValueError("secret")) == "Internal error: ValueError"
