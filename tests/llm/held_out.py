"""Labelled lines that the random field of operator 9 is not trained on, in the form of its training table."""

#: Looked at while features were chosen.
SEEN = """
please email kate/e at/e school/e dot/e edu/e about the class
her new address is lee.p/e [at]/e house/e [dot]/e info/e from May
drop a line to zed9/e (at)/e post/e (dot)/e net/e this week
reach him under joe/e at/e shop/e dot/e com/e in the morning
correo marta/e arroba/e casa/e punto/e es/e por favor
e-mail rolf/e at/e verein/e punkt/e de/e am Montag
we sat at the table and looked at the sea
the dot was at the end of the line
he came at ten and left at noon
meet me at the corner by the old mill
call 555/p 765/p 4321/p in the evening
phone: (303)/p 555-0177/p for the office
mobile 0160/p 5559876/p is switched off
fax (040)/p 555-1212/p on weekdays
Telefon 0221/p 555678/p ab neun
she said 415-555-0133/p was right
tel 6175550142/p rings
the year 1987 and the year 2003 were good
about 700 of 1500 houses stood empty
we need 12 eggs and 3 pounds of flour
pages 210 to 245 were torn
card 5425/c 2334/c 3010/c 9903/c was declined
visa 4263982640269299/c expires soon
thing 4917484589897107 with that
over 4001919257537193 again
Kreditkarte 5274576394259961/c gesperrt
carte 4000056655665556/c volée
order 4263982640269299 shipped yesterday
invoice 123456789012 was paid
tracking 4917484589897107 is lost
isbn 9780306406157 in print
server 10.20.30.40/i went down
host 192.0.2.55/i replied
Mr Baker/n lives there
Mrs Olsen/n paid
Dr Nora/n Quinn/n is in
Dear William/n we thank you
my name is Ruth/n Adams/n and
Herr Otto/n Lang/n wartet
Frau Ilse/n Vogt/n kam
Madame Sylvie/n Roux/n parle
señora Carmen/n Vega/n espera
Contact Oscar/n Wood/n for the keys
The name of The river changed. Then It rained
Rain fell. The Road was wet. People ran
In the Spring they planted. In Autumn they sold
Der Hund lief in den Wald und der Mann rief
Le matin il part. Le soir il revient
LONDON AND PARIS ARE FAR
he gave the name to the dog
the contact list was empty
hello from the other side
it is There. It was Here
no more of it. No time
forward it to nina/e at/e garden/e dot/e org/e with the photos
send bills to office.42/e [at]/e trade/e [dot]/e com/e only
his mail is sam/e (at)/e boats/e (dot)/e net/e since June
the cat sat at the door near the dot on the wall
look at him and at her
ring me on 555/p 301/p 2244/p after lunch
telephone (718)/p 555-0101/p for seats
Tel. 030/p 5554433/p fragen
handy 0176-5552-331/p ist neu
phone 8005550199/p is free
in 1871 and in 1914 wars began
there are 365 days and 52 weeks
the room holds 2500 people
mastercard 5555/c 4444/c 3333/c 1111/c on file
card number 4242424242424242/c was typed
stop 6011111111111117/c there
serial 4242424242424242 on the back
id 20231105123456 in the log
ip 203.0.113.77/i blocked
router 172.20.1.1/i answers
Ms Clara/n Hughes/n wrote
Dr Ahmed/n Khan/n treats
Sir Walter/n Scott/n wrote
the name is Greta/n and she sings
Frau Schmidt/n lacht
Monsieur Leroy/n sort
Don Pablo/n Neruda/n canta
Regards Emily/n Stone/n
When The sun rose He left
Paris is big. Berlin is old
Die Sonne und der Mond
the old name of the town
he will call at six
""".strip()

#: Written after the features of round 2 were chosen. In round 3 a rule on articles was added after a false find here was seen.
UNSEEN = """
tickets from ella/e at/e stage/e dot/e com/e only
my mail is hugo.9/e (at)/e farm/e (dot)/e org/e now
write to postbox/e [at]/e bridge/e [dot]/e net/e
he stood at a dot of light
call 555/p 818/p 3322/p on Sunday
fax (0221)/p 555-6677/p works
phone +1/p 555/p 010/p 9988/p today
in 1066 some 8000 men came
card 4999000011112222/c blocked
amex number 371449635398430/c stolen
tracking number 4999000011112222 found
the 4999000011112222 there
host 198.51.100.9/i up
Mr Tanaka/n bowed
Dr Lena/n Fischer/n and Prof Ivan/n Petrov/n
My name is Omar/n
Frau Clara/n Zetkin/n sprach
Madame Curie/n
The Great War. It ended
then he is Gone
""".strip()

#: Written by a reviewer of the field, who had not seen its table; cues of these kinds were added to the table since.
REVIEWED = """
Sincerely, Maria/n Lopez/n
reach Ahmed/n Hassan/n at noon
Kontakt: Jürgen/n Müller/n, Berlin
J./n R./n Tolkien/n wrote it
write joe[at]site[dot]com/e
jane/e dot/e doe/e at/e example/e dot/e com/e
My phone is 555/p 0199/p
ring me on 07700/p 900123/p
SSN 123-45-6789
invoice 4929123456789012
Chapter 12 pages 100 200 300
""".strip()

#: Written before the field was trained on the wider table. Its one miss was seen, and nothing was changed for it.
LATER = """
Yours truly, Victor/n Hale/n
Please reach Ingrid/n Solberg/n by Friday
Kontakt: Sabine/n Krause/n, Leipzig
E./n M./n Forster/n travelled
T./n Becker/n kommt morgen
mail pat[at]lake[dot]net/e first
write rob(at)hills(dot)org/e tonight
send it to mike/e dot/e stone/e at/e valley/e dot/e org/e now
his phone is 555/p 0123/p and hers is not
my phone is 303/p 555/p 0155/p since May
ring us on 07911/p 555321/p after six
text her on 07700/p 900111/p
call me back at 555/p 0166/p
fax them under (089)/p 555-7070/p
ssn 321-54-9876 was printed
social code 111-22-3333
invoice 4111999922223333 is due
order number 4000999911112222 left
Rechnung 378282246310005 bezahlt
pages 10 20 30 of chapter 4
see section 3 lines 200 to 340
the years 1980 1990 2000
she ran 12 km in 90 minutes
card is 5454/c 5454/c 5454/c 5454/c there
visa number 4917610000000000/c was stolen
ask Miriam/n Cohen/n first
tell them that it rained
thanks to all of you
Thanks, Boris/n
Cheers, Lily/n Chan/n
Mr Novak/n, Prague and Vienna
it was plan A. Then plan B
Rome, Milan, Naples
we thank the town
Dear Agnes/n, the roof leaks
Prof Weiss/n explained it
host 10.9.8.7/i failed
""".strip()
