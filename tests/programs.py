"""Small programs of our own, the files they read, and what a run must write."""

LIBRARY = {
    "shapes.shex": """
PREFIX lib: <https://library.example/voc#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>

lib:Reader { lib:name xsd:string ; lib:mail xsd:string ? }
lib:Loan { lib:fee xsd:double ; lib:taken_by @lib:Reader }
""",
    "readers.csv": "card,mail,name,age\n007,a@x.example,Ada,41\n008,,Bo,17\n009,c@x.example,Cy,18\n",
    "loans.csv": "id,card,fee\n1,007,2.5\n2,009,1\n3,007,0.25\n4,008,9\n",
    "program": """
type { Reader, Loan } := io.shex("shapes.shex")

Row  := io.csv("readers.csv")
Lent := io.csv("loans.csv")
Grown := Row.where(Row.age >= 18)

Readers : Reader from Grown
    @subject = "https://library.example/reader/{Row.card}"
    name     = Row.name
    mail     = Row.mail

Loans : Loan from Lent.join(Row, on = Lent.card == Row.card)
    @subject = "https://library.example/loan/{Lent.id}"
    fee      = Lent.fee
    taken_by = Reader(Row.card)   // the minor's loan finds no vertex
""",
    "vertices": {"Reader": 2, "Loan": 4},
    "edges": {"Loan_taken_by_Reader": (3, 1)},
}

HARBOUR = {
    "ship.csv": "id|name|port\n1|Alca|10\n2|Brig, the|11\n3|Cog|10\n",
    "port.csv": "id|name\n10|Ost\n11|West\n",
    "meets.csv": "Ship.id|Ship.id|when\n1|2|2020-01-01\n1|3|2020-02-01\n2|1|2020-03-01\n",
    "flag.csv": "ship,lang,text\n1,en,Red\n1,DE,Rot\n2,en,Blue\n",
    "program": """
@iri("https://harbour.example/voc#Port")
@annotation("http://www.w3.org/2000/01/rdf-schema#label", "port"@en)
type Port
    @iri("https://harbour.example/voc#name") name: String

@iri("https://harbour.example/voc#Ship")
type Ship
    @iri("https://harbour.example/voc#title")  name: String
    @iri("https://harbour.example/voc#flag")   flag: Seq<String<Lang>>
    @iri("https://harbour.example/voc#home")   home: Ref<Port>
    @iri("https://harbour.example/voc#met")    met: Seq<Ref<Ship>>

ShipRow := io.csv("ship.csv", delimiter = "|")
PortRow := io.csv("port.csv", delimiter = "|")
MeetRow := io.csv("meets.csv", delimiter = "|")
FlagRow := io.csv("flag.csv")

Ports : Port from PortRow
    @subject = "https://harbour.example/port/{PortRow.id}"
    name     = PortRow.name

Ships : Ship from ShipRow
    @subject = "https://harbour.example/ship/{ShipRow.id}"
    name     = ShipRow.name
    home     = Port(ShipRow.port)

Met : Ship from ShipRow.join(MeetRow, on = ShipRow.id == MeetRow."Ship.id")
    @subject = "https://harbour.example/ship/{ShipRow.id}"
    name     = ShipRow.name
    home     = Port(ShipRow.port)
    met      = Ship(MeetRow."Ship.id_1")

Flags : Ship from ShipRow.join(FlagRow, on = ShipRow.id == FlagRow.ship)
    @subject = "https://harbour.example/ship/{ShipRow.id}"
    name     = ShipRow.name
    home     = Port(ShipRow.port)
    flag     = FlagRow.text.lang(FlagRow.lang)
""",
    "vertices": {"Port": 2, "Ship": 3},
    "edges": {"Ship_home_Port": (3, 0), "Ship_met_Ship": (3, 0)},
}

OBSERVATORY = {
    "shapes.ttl": """
PREFIX sh: <http://www.w3.org/ns/shacl#>
PREFIX o: <https://sky.example/voc#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
o:S a sh:NodeShape ; sh:targetClass o:Star ;
  sh:property [ sh:path o:label ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ;
  sh:property [ sh:path o:band ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ;
  sh:property [ sh:path o:ratio ; sh:datatype xsd:double ; sh:maxCount 1 ] ;
  sh:property [ sh:path o:left ; sh:datatype xsd:integer ; sh:maxCount 1 ] ;
  sh:property [ sh:path o:seen ; sh:datatype xsd:date ; sh:maxCount 1 ] ;
  sh:property [ sh:path o:bright ; sh:datatype xsd:boolean ; sh:maxCount 1 ] ;
  sh:property [ sh:path o:tags ; sh:datatype xsd:string ] .
""",
    "stars.json": '[{"id":"s1","label":" Vega  Prime ","mag":3,"n":7,"seen":"14 Mar 2026","tags":"a;b;a"},'
    '{"id":"s2","label":"Rigel","mag":-2,"n":4,"seen":"1 Jan 2025","tags":"c"},'
    '{"id":"s3","label":"Deneb","mag":0,"n":5,"seen":null,"tags":null},{"id":"s4","label":null,"mag":1,"n":1,"seen":null,"tags":"x"}]',
    "program": """
type { Star } := io.shacl("shapes.ttl")
Row := io.json("stars.json")
Known := Row.where(Row.label != null and not (Row.mag > 100)).distinct()

Stars : Star from Known
    @subject = "https://sky.example/star/{str.upper(Row.id)}"
    label    = Row.label.trim()
    band     = Row.mag > 2 ? "far" : Row.mag < 0 ? "near" : "mid"
    ratio    = Row.mag / (Row.n - 4)
    left     = Row.n % 3 + 2 * Row.mag
    seen     = parse.date(Row.seen, format = "%d %b %Y")
    bright   = Row.mag > 2 or Row.mag == 0 and Row.n == 5
    tags     = Row.tags.split(";")
""",
    "vertices": {"Star": 3},
    "edges": {},
}

MARKET = {
    "shapes.shex": """
PREFIX m: <https://market.example/voc#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
m:Total { m:buyer xsd:string ; m:sum xsd:double ; m:most xsd:double }
m:Pair { m:label xsd:string ; m:above xsd:string }
""",
    "a.csv": "buyer,amount\nx,1\ny,2\nx,3\n",
    "b.csv": "buyer,amount\ny,10\nz,4\n",
    "tree.csv": "id,parent,label\n1,,root\n2,1,left\n3,1,right\n4,2,leaf\n",
    "program": """
type { Total, Pair } := io.shex("shapes.shex")
A := io.csv("a.csv")
B := io.csv("b.csv")
All := A.union(B)
PerBuyer := All.group_by(All.buyer, sum = math.sum(All.amount), most = math.max(All.amount))
Node := io.csv("tree.csv")

Totals : Total from PerBuyer
    @subject = "https://market.example/total/{All.buyer}"
    buyer    = All.buyer
    sum      = PerBuyer.sum
    most     = PerBuyer.most

Pairs : Pair from Node.join(Node as Up, on = Node.parent == Up.id)
    @subject = "https://market.example/pair/{Node.id}"
    label    = Node.label
    above    = Up.label
""",
    "vertices": {"Total": 3, "Pair": 3},
    "edges": {},
}

PROGRAMS = {"library": LIBRARY, "harbour": HARBOUR, "observatory": OBSERVATORY, "market": MARKET}

#: Changes to a program that make it wrong, and the code that says so: (program, what is replaced, by what, code).
WRONG = [
    ("library", "Row.name\n", "Row.nmae\n", "name/unknown-field"),
    ("library", "name     = Row.name\n", "title    = Row.name\n", "name/unknown-property"),
    ("library", "    name     = Row.name\n", "", "shape/missing-required-property"),
    ("library", "fee      = Lent.fee", "fee      = Row.name", "type/property-mismatch"),
    ("library", "taken_by = Reader(Row.card)", "taken_by = Loan(Row.card)", "type/property-mismatch"),
    ("library", "taken_by = Reader(Row.card)", "taken_by = Reader(Row.card, Row.age)", "identity/edge-arity"),
    ("library", "on = Lent.card == Row.card", "on = Lent.card == Lent.id", "pipeline/join-one-side"),
    ("library", "on = Lent.card == Row.card", "on = Lent.card < Row.card", "pipeline/join-not-equality"),
    ("library", "on = Lent.card == Row.card", 'on = Lent.card == "7"', "pipeline/join-key-not-column"),
    ("library", "Row.where(Row.age >= 18)", "Row.keep(Row.age >= 18)", "pipeline/unknown-verb"),
    ("library", "Row.where(Row.age >= 18)", "Row.where(Row.age)", "type/expected-bool"),
    ("library", "Row.where(Row.age >= 18)", 'Row.where(Row.age >= "18")', "type/incomparable"),
    ("library", "Row.where(Row.age >= 18)", "Row.where()", "pipeline/stage-arity"),
    ("library", "Row.where(Row.age >= 18)", "Row.where(Lent.fee > 1)", "name/row-not-in-scope"),
    ("library", "Row.where(Row.age >= 18)", "Grown.where(Row.age >= 18)", "pipeline/cycle"),
    ("library", "Row.where(Row.age >= 18)", "Row.union(Lent)", "pipeline/union-mismatch"),
    ("library", "Row.where(Row.age >= 18)", "Row.union(Row as R)", "pipeline/union-alias"),
    ("library", "name     = Row.name", "name     = Row.name.shout()", "name/unknown-function"),
    ("library", "name     = Row.name", "name     = str.trim(Row.name, Row.name)", "argument/arity"),
    ("library", "name     = Row.name", "name     = str.trim(Row.age)", "type/argument-mismatch"),
    ("library", "name     = Row.name", 'name     = Row.name + "!"', "type/expected-number"),
    ("library", "name     = Row.name", 'name     = Row.age > 3 ? "a" : 4', "type/branch-mismatch"),
    ("library", "name     = Row.name", "name     = math.sum(Row.age)", "unsupported/expression"),
    ("library", "name     = Row.name", "name     = null", "type/property-mismatch"),
    ("library", "name     = Row.name", "name     = Row", "type/relation-as-value"),
    ("library", "name     = Row.name", 'name     = Row."name"', "syntax/needless-quotes"),
    ("library", "fee      = Lent.fee", "fee      = 1 < 2 < 3", "syntax/unexpected-token"),
    ("library", "fee      = Lent.fee", "fee      = Lent.fee\n    fee      = Lent.fee", "name/duplicate-field"),
    ("library", '"https://library.example/loan/{Lent.id}"', '"https://library.example/loan/{Lent.id}', "syntax/expected-token"),
    ("library", 'io.csv("loans.csv")', 'io.csv("loans.json")', "provider/wrong-extension"),
    ("library", 'io.csv("loans.csv")', 'io.csv("gone.csv")', "source/not-found"),
    ("library", 'io.csv("loans.csv")', 'io.shex("shapes.shex")', "provider/wrong-capability"),
    ("library", 'io.csv("loans.csv")', 'io.csv("loans.csv", quote = "x")', "provider/foreign-reader-option"),
    ("library", 'io.csv("loans.csv")', 'io.csv("loans.csv", delimiter = "||")', "provider/invalid-reader-option"),
    ("library", "type { Reader, Loan }", "type { Reader, Debt }", "shape/not-in-document"),
    ("library", "Loans : Loan from", "Loans : Lown from", "name/unknown-shape"),
    ("harbour", '"https://harbour.example/ship/{ShipRow.id}"\n    name     = ShipRow.name\n    home     = Port(ShipRow.port)\n    met', '"https://harbour.example/ship/{ShipRow.port}"\n    name     = ShipRow.name\n    home     = Port(ShipRow.port)\n    met', "identity/conflicting"),
    ("harbour", "home: Ref<Port>", "home: Ref<Quay>", "name/unknown-type"),
    ("harbour", "name: String\n\n", "name: Text\n\n", "type/invalid-field-type"),
    ("market", "sum = math.sum(All.amount)", "sum = str.trim(All.buyer)", "pipeline/not-an-aggregate"),
    ("market", "All.group_by(All.buyer, sum", "All.group_by(sum", "pipeline/stage-arity"),
    ("market", "Node.join(Node as Up, on = Node.parent == Up.id)", "Node.join(Node, on = Node.parent == Node.id)", "pipeline/invalid-stage-argument"),
]
