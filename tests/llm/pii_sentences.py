"""Hand-written sentences with the personal data in them, apart from the training generator."""

SENTENCES = [
    ("Please write to maria.keller@posteo.example.org before Friday.", [("maria.keller@posteo.example.org", "email")]),
    ("Reach me at j.doe (at) university.example.edu if the link is broken.", [("j.doe (at) university.example.edu", "email")]),
    ("My address is sam [at] workshop [dot] example [dot] net, thanks!", [("sam [at] workshop [dot] example [dot] net", "email")]),
    ("Contact: lena at studio.example.com or ask at the front desk.", [("lena at studio.example.com", "email")]),
    ("Send the forms to office(at)clinic.example.de by post or mail.", [("office(at)clinic.example.de", "email")]),
    ("Her old mail was anna_k at webmail dot org, I think.", [("anna_k at webmail dot org", "email")]),
    ("We met at noon. The dot on the map is where we stood.", []),
    ("She works at night and sleeps at dawn; see chapter 3.2 for why.", []),
    ("The server at 10.20.30.40 answered, the one at 192.168.0.17 did not.", [("10.20.30.40", "ip"), ("192.168.0.17", "ip")]),
    ("Block 203[.]0[.]113[.]9 in the firewall.", [("203[.]0[.]113[.]9", "ip")]),
    ("Defanged indicator: 198[.]51[.]100[.]23 seen twice.", [("198[.]51[.]100[.]23", "ip")]),
    ("Version 1.2.3 was followed by 1.2.4 and then by 2.0.", []),
    ("The office number is (212) 555-0187, extension 4.", [("(212) 555-0187", "phone")]),
    ("Call 415-555-0132 after six or leave a message.", [("415-555-0132", "phone")]),
    ("Tel. 0049 30 1234 5678, Mo-Fr.", [("0049 30 1234 5678", "phone")]),
    ("From abroad dial +44 20 7946 0958.", [("+44 20 7946 0958", "phone")]),
    ("fax 212.555.0199 / switchboard 212.555.0100", [("212.555.0199", "phone"), ("212.555.0100", "phone")]),
    ("Orders 2023-10-05 to 2023-11-05 shipped late.", []),
    ("In 1987 there were 12,450 houses and 3.5 people in each.", []),
    ("Paid with 4111 1111 1111 1111 on the third of May.", [("4111 1111 1111 1111", "card")]),
    ("card no. 5500-0000-0000-0004, valid", [("5500-0000-0000-0004", "card")]),
    ("They stored 4012.8888.8888.1881 in plain text.", [("4012.8888.8888.1881", "card")]),
    ("The code 4111 1111 1111 1112 has a wrong check digit.", []),
    ("ISBN 9780306406157 is a book, not a card.", []),
    ("Sequence 1 2 3 4 5 6 7 8 9 10 11 12 13 14.", []),
    ("Coordinates 52.5200, 13.4050 and 48.8566, 2.3522.", []),
    ("Le bureau: 01 44 55 66 77, ou par mail a paul.martin@exemple.example.fr.", [("01 44 55 66 77", "phone"), ("paul.martin@exemple.example.fr", "email")]),
    ("Escriba a ventas(at)tienda.example.es o llame al 915 555 012.", [("ventas(at)tienda.example.es", "email")]),
    ("The function foo(x) at line 120 of bar.py raised an error.", []),
    ("We scored 21-14, 28-7 and 35-10 in the last three games.", []),
]
