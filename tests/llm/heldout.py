"""Texts for problem 10 in wordings that the sample documents do not have: text, and what it holds by type.

Both lists are by the hand that wrote the rules, after reading sample documents. TEXTS served to mend rules. FURTHER
was measured once before any rule was changed for it (the figures are in README); leads of names came after that.

Types: e email, p phone, i id_number, s street_address, n person_name, c card_number, a account_number.
"""

TEXTS = [
    ("Contact Priya Sharma about it; John Smith emailed.", {"n": ["Priya Sharma", "John Smith"]}),
    ("Thanks, Maria Gonzalez from billing", {"n": ["Maria Gonzalez"]}),
    ("Hello, I'm Peter O'Connor and my flat is at 12 Rosewood Avenue, Leeds.", {"n": ["Peter O'Connor"], "s": ["12 Rosewood Avenue"]}),
    ("Please wire it to my IBAN GB82 WEST 1234 5698 7654 32 by Friday.", {"a": ["GB82 WEST 1234 5698 7654 32"]}),
    ("Mein Konto: DE89 3704 0044 0532 0130 00, danke.", {"a": ["DE89 3704 0044 0532 0130 00"]}),
    ("The IBAN DE89 3704 0044 0532 0130 01 bounced.", {}),
    ("I paid with 4539 5787 6362 1486 and never got a receipt.", {"c": ["4539 5787 6362 1486"]}),
    ("My card number is 4539578763621486.", {"c": ["4539578763621486"]}),
    ("My card number is 4539578763621487.", {}),
    ("The parcel reference 4539 5787 6362 1486 is lost.", {}),
    ("Her aadhaar is 2345 6789 0124 as printed.", {"i": ["2345 6789 0124"]}),
    ("Her aadhaar is 2345 6789 0123 as printed.", {}),
    ("It showed 2345 6789 0124 next to my photo.", {"i": ["2345 6789 0124"]}),
    ("It showed 2345 6789 0123 next to the total.", {}),
    ("DNI 12345678Z, caducado en mayo.", {"i": ["12345678Z"]}),
    ("DNI 12345678A, caducado en mayo.", {}),
    ("They want my NIE X1234567L again.", {"i": ["X1234567L"]}),
    ("SSN 123-45-6789 was on the form.", {"i": ["123-45-6789"]}),
    ("National insurance: QQ 12 34 56 C", {"i": ["QQ 12 34 56 C"]}),
    ("Her passport number is 533380006, issued in London.", {"i": ["533380006"]}),
    ("Steuer-ID 86095742719 liegt bei.", {"i": ["86095742719"]}),
    ("Steuer-ID 86095742710 liegt bei.", {}),
    ("My PAN is ABCPE1234F.", {"i": ["ABCPE1234F"]}),
    ("Numéro de sécurité sociale: 2 55 08 14 168 025 38", {"i": ["2 55 08 14 168 025 38"]}),
    ("My social insurance number is 046 454 286.", {"i": ["046 454 286"]}),
    ("My social insurance number is 046 454 287.", {}),
    ("Order 123456789012 and tracking number 998877665544 are late.", {}),
    ("Ticket 87654321 was closed on 2024-05-17 at 10:45.", {}),
    ("The build took 1234567 ms over 10.20.30.40.", {}),
    ("You can reach me at +44 20 7946 0018 before noon.", {"p": ["+44 20 7946 0018"]}),
    ("Call (415) 555-2671 or 415-555-2672, please.", {"p": ["(415) 555-2671", "415-555-2672"]}),
    ("Mon portable: 06 12 34 56 78, merci.", {"p": ["06 12 34 56 78"]}),
    ("Telefon 030 1234567, Handy 0171 2345678.", {"p": ["030 1234567", "0171 2345678"]}),
    ("WhatsApp me on +91 98765 43210.", {"p": ["+91 98765 43210"]}),
    ("My mobile 9876543210 is switched off.", {"p": ["9876543210"]}),
    ("The total was 415 555 items in 2671 rows.", {}),
    ("Version 2.415.555 replaced 1.200.300.", {}),
    ("Scores 415-555 and 267-112 were shown.", {}),
    ("Write to jane.doe@example.co.uk or j_doe99@mail.example.", {"e": ["jane.doe@example.co.uk", "j_doe99@mail.example"]}),
    ("It is jane dot doe at example dot org.", {"e": ["jane dot doe at example dot org"]}),
    ("Use jane(at)example(dot)org instead.", {"e": ["jane(at)example(dot)org"]}),
    ("Follow @jane_doe; the sale starts at 10.", {}),
    ("We live at 221B Baker Street near the park.", {"s": ["221B Baker Street"]}),
    ("Deliver to 1600 Pennsylvania Ave NW, not the shop.", {"s": ["1600 Pennsylvania Ave"]}),
    ("She moved to 45 Park Lane last year.", {"s": ["45 Park Lane"]}),
    ("Unsere Adresse: Hauptstraße 12a, Berlin.", {"s": ["Hauptstraße 12a"]}),
    ("Ich wohne Berliner Straße 7 im Hof.", {"s": ["Berliner Straße 7"]}),
    ("J'habite 14 rue de la Paix à Paris.", {"s": ["14 rue de la Paix"]}),
    ("Vivo en Calle Mayor 22, segundo.", {"s": ["Calle Mayor 22"]}),
    ("Flat owners of 9 Elm Grove got 3 letters.", {"s": ["9 Elm Grove"]}),
    ("Only 5 Road bikes are left, 12 people are on the way.", {}),
    ("It took 20 minutes of my way home.", {}),
    ("Best 10 Street Food places in town", {}),
    ("It closes in 3 days, place the order now.", {}),
    ("After 9 short steps drive the point home.", {}),
    ("Dr. Aisha Khan called me back at noon.", {"n": ["Aisha Khan"]}),
    ("I talked to Mr. Wojciech Kowalczyk at the counter.", {"n": ["Wojciech Kowalczyk"]}),
    ("Signed, Emily R. Thornton", {"n": ["Emily R. Thornton"]}),
    ("Yesterday Sanjay Mehta promised a refund.", {"n": ["Sanjay Mehta"]}),
    ("my name is laura becker, thanks", {"n": ["laura becker"]}),
    ("Customer: Müller, Hans", {"n": ["Müller, Hans"]}),
    ("Dear Ms. Ingrid Solheim, your claim is open.", {"n": ["Ingrid Solheim"]}),
    ("I was helped by Juan Carlos Ortega at reception.", {"n": ["Juan Carlos"]}),
    ("Ich heiße Katrin von Lossow.", {"n": ["Katrin von Lossow"]}),
    ("Je m'appelle Jean-Pierre Dubois.", {"n": ["Jean-Pierre Dubois"]}),
    ("The nurse told Fatima Al-Sayed to wait.", {"n": ["Fatima Al-Sayed"]}),
    ("Robert Hale's phone rang all night.", {"n": ["Robert Hale"]}),
    ("The Golden Palace Hotel charges extra.", {}),
    ("Terms Apply. Limited Offer on Blue Velvet Sofas.", {}),
    ("Buy Super Saver from Northern Trading Company today.", {}),
    ("my name is not on the list.", {}),
    ("Compare Silver Cloud with Green Valley before you pay.", {}),
    ("Red Fox Boots shipped from New Haven on Monday.", {}),
    ("The Privacy Notice said Free Trial ends Sunday Evening.", {}),
]

FURTHER = [
    ("Hallo, hier ist Sabine Krüger, meine Nummer lautet 0151 23456789.", {"n": ["Sabine Krüger"], "p": ["0151 23456789"]}),
    ("The courier left it with Tom Whitfield at number 14 Cedar Close.", {"n": ["Tom Whitfield"], "s": ["14 Cedar Close"]}),
    ("Kind regards, Deborah Lim", {"n": ["Deborah Lim"]}),
    ("Mrs Okonkwo-Bright rang twice; Chidi Okonkwo did not.", {"n": ["Chidi Okonkwo"]}),
    ("Ask for Yuki Tanaka on extension 4412.", {"n": ["Yuki Tanaka"]}),
    ("I, Gareth Pugh, want my money back.", {"n": ["Gareth Pugh"]}),
    ("Signed by ANNA MARIA ROSSI on Monday.", {"n": ["ANNA MARIA"]}),
    ("My husband Miguel Ferrer paid for it.", {"n": ["Miguel Ferrer"]}),
    ("Passenger: Lindqvist, Erik", {"n": ["Lindqvist, Erik"]}),
    ("Please forward to Claire Dumont, 8 rue des Lilas, Lyon.", {"n": ["Claire Dumont"], "s": ["8 rue des Lilas"]}),
    ("Mail me: k.meyer-schulz@post.example or call +49 30 901820.", {"e": ["k.meyer-schulz@post.example"], "p": ["+49 30 901820"]}),
    ("contact = ops_team {at} site {dot} example", {"e": ["ops_team {at} site {dot} example"]}),
    ("Ring 020 7946 0991 after lunch, not 0800 numbers.", {"p": ["020 7946 0991"]}),
    ("Fax: +33 1 42 68 53 00", {"p": ["+33 1 42 68 53 00"]}),
    ("SMS to 98765-43210 works.", {"p": ["98765-43210"]}),
    ("Use 555-0134 for the front desk.", {"p": ["555-0134"]}),
    ("My SSN ends with 6789, full one 219-09-9999.", {"i": ["219-09-9999"]}),
    ("Passport K1234567 expires soon.", {"i": ["K1234567"]}),
    ("Her driving licence number is MORGA657054SM9IJ.", {"i": ["MORGA657054SM9IJ"]}),
    ("National ID 8001015009087 was refused.", {"i": ["8001015009087"]}),
    ("NIF: 87654321X", {"i": ["87654321X"]}),
    ("Personalausweis L01X00T471 liegt vor.", {"i": ["L01X00T471"]}),
    ("TIN 12-3456789 on file", {"i": ["12-3456789"]}),
    ("Pan card ABCPK1234Z please.", {"i": ["ABCPK1234Z"]}),
    ("We moved from 7/3 Gandhi Marg to 22 MG Road.", {"s": ["7/3 Gandhi Marg", "22 MG Road"]}),
    ("The house is at 4 Quay Street.", {"s": ["4 Quay Street"]}),
    ("Lieferung an Am Markt 5, bitte.", {"s": ["Am Markt 5"]}),
    ("Vive en Avenida de la Paz 101.", {"s": ["Avenida de la Paz 101"]}),
    ("Wohnhaft in Goethestr. 19, Jena", {"s": ["Goethestr. 19"]}),
    ("deliver to 16 oak lane please", {"s": ["16 oak lane"]}),
    ("Visa 4111 1111 1111 1111 was charged.", {"c": ["4111 1111 1111 1111"]}),
    ("Amex 3782 822463 10005 as well.", {"c": ["3782 822463 10005"]}),
    ("Refund to FR14 2004 1010 0505 0001 3M02 606.", {"a": ["FR14 2004 1010 0505 0001 3M02 606"]}),
    ("Invoice 2024-000187 from Brown & Sons Ltd.", {}),
    ("Flight LH 1234 leaves at gate B12 in 45 minutes.", {}),
    ("Room 101 on Second Floor, Palace Court Hotel", {}),
    ("The Silent Forest Trail is 12 miles long.", {}),
    ("See chapter 3, page 415, line 555.", {}),
    ("Serial no. 4929 1234 5678 9012 on the box", {}),
    ("Big Summer Sale by Green Leaf Foods", {}),
    ("Dear Customer Service, nothing works.", {}),
    ("He said Good Morning and left.", {}),
    ("Order 4111111111111111 never came.", {}),
    ("Between 10 and 12 Park and Ride buses ran.", {}),
]
