"""The tables that a run is reviewed by."""

from tallyforge.plans import consolidate


def test_review_of_a_run(spark):
    body = [[f"C{k}", f"{10 + k},50", 1.0] for k in range(8)]
    body[3][1] = "n/a"
    sheets = {
        "one": [["Ventes"], [], ["Contrat", "Prime", "Frais", "Autre"], *[[*b, "x"] for b in body], [], ["C9", "7,00", 2.0, "x"], ["Total", 1.0, 2.0, None]],
        "bare": [["Contrat", "Prime", "Frais"], ["Total", 3.0, 1.0]],
    }

    def cells():
        for name, lines in sheets.items():
            for r, line in enumerate(lines, 1):
                for c, v in enumerate(line, 1):
                    if v is not None:
                        yield (name, r, c, "n" if isinstance(v, float) else "s", None if isinstance(v, float) else v, v if isinstance(v, float) else None, None)

    table = spark.createDataFrame(list(cells()), "file_id string, row int, col int, kind string, s string, n double, d date")
    files = spark.createDataFrame([(n, f"in/{n}.xlsx", "S", "ALPHA", "vie", "2025-01", None, e) for n, e in (("one", None), ("bare", None), ("lost", "damaged"))], "file_id string, path string, sheet string, bank string, produit string, period string, source_format string, error string")
    aliases = spark.createDataFrame([("seed", None, "contrat", "num_contrat"), ("seed", None, "prime", "prime_nette"), ("seed", None, "frais", "frais")], "tier string, scope string, alias string, canonical string")
    fields = [("num_contrat", "identifier"), ("prime_nette", "money"), ("frais", "money"), ("prime_totale", "money"), ("agence", "text")]
    run = consolidate.consolidate(table, files, aliases, fields, {"prime_totale": [("sum", ["prime_nette", "frais"])]}, "t")
    tables = run.review(["num_contrat", "agence"])
    got = {r.fichier: r.asDict() for r in tables["files"].collect()}
    assert all(len(r) == 19 for r in got.values()) and sorted(got) == ["bare.xlsx", "lost.xlsx", "one.xlsx"]
    one = got["one.xlsx"]
    assert (one["ligne_entete"], one["premiere_ligne"], one["derniere_ligne"], one["lignes_gardees"]) == (3, 4, 13, 9)
    assert (one["colonnes_gardees"], one["entetes_non_resolus"], one["champs_calcules"], one["champs_requis_absents"], one["statut"]) == (4, 1, "prime_totale", "agence", "à vérifier")
    assert (got["lost.xlsx"]["statut"], got["lost.xlsx"]["note"], got["lost.xlsx"]["ligne_entete"]) == ("erreur", "damaged", None)
    assert (got["bare.xlsx"]["note"], got["bare.xlsx"]["lignes_gardees"], got["bare.xlsx"]["lignes_supprimees"]) == ("header found but no data rows beneath it", 0, 1)
    assert {(r.en_tete, r.champ) for r in tables["mappings"].collect()} == {("Contrat", "num_contrat"), ("Prime", "prime_nette"), ("Frais", "frais"), ("Autre", "(non résolu)")}
    dropped = {(r.fichier, r.type, r.position): (r.motif, r.contenu) for r in tables["dropped"].collect()}
    assert dropped["one.xlsx", "ligne", "ligne 12"] == ("blank row inside table", "") and dropped["one.xlsx", "ligne", "ligne 14"][1].startswith("Total | ")
    assert one["lignes_supprimees"] == sum(k[0] == "one.xlsx" for k in dropped)
    wrong = tables["coercions"].collect()
    assert [(r.fichier, r.en_tete, r.type_cible, r.separateur_decimal, r.converties, r.echecs, r.taux_echec, r.exemples) for r in wrong] == [("one.xlsx", "Prime", "money", ",", 8, 1, "11%", "n/a")]
