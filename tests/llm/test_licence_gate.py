from lustrum.llm import licenses as L

MET = (
    "This work is under a CC BY 4.0 licence.", "Licenced under the MIT licence.", "Published under the GPL-3.0 licence.", "Licence: CC BY-SA 4.0", "SPDX: MIT", "Published under MIT", "A licence.",
)
PASSED = ("Sie geht mit dem Hund.", "Nothing of the kind here.", "Der Hund kam mit.")


def test_short_and_british_notices_reach_the_classifier(make_docs):
    texts = [*MET, *PASSED]
    got = {r.doc_id: r.n_licence for r in L.scan_documents(make_docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [1] * len(MET) + [0] * len(PASSED)
