"""Phrases that speech recognition writes where nobody speaks, in lower case.

The values of the source's own lists (modules/speech/hallucinations, Apache License 2.0), of five characters or more.
"""

#: Count anywhere in a text, whatever their length.
EXTRAS = ("dimatorzok",)

PHRASES = (
    *"""\
all right.
because i have not done that in the last few years.
but i grow them
but i grow young
bye bye.
bye-bye.
can i go?
do you want me to turn it off?
have a good night, guys.
i'll see you next time.
i love you.
i'm happy to be here.
i'm just a form.
let's do that again.
nice.
okay.
okay, thank you.
so i am going to turn this off.
thanks for watching!
thanks for watching.
thanks for watching, and i'll see you next time.
thank you.
thank you for having me.
thank you for listening.
thank you for today.
thank you for your time.
thank you so much.
thank you very much.
thank you very much for coming.
that i thought i'd just like to talk about for a minute.
yeah.
thank you for your time, and i'll see you next time.
thank you so much for joining us.
thank you so much for joining us today, and we'll see you next time.
thanks.
i'm going to be here to give you more money.
we have to be cool.
thank you so much for joining us today.
i'm so glad to be here.
i am so glad to have you all the time to work out with you.
that's where i'm at.
oh, i got this job.
oh, i got this stuff.
i feel ready to switch.
i say feel ready to switch, try the switch to play.
i'm going to try the switch to side two.
i'm gonna try the switch to side too.
i'm going to try the switch to side 2.
i got this at the time.
oh, what's that?
you know, ryan.
all right, all right, all right.
thank you, mr. president.
thank you all.
thank you so much for joining us, thank you for joining us, thank you for joining us.
thank you so much for joining us, and thank you so much for joining us.
thank you so much for joining us, thank you so much for joining us, thank you so much.
and then what is the end of the family?
god bless you.
oh, my god.
it's awesome.
that's it.
that's the whole thing.
i'll tell you what, i'll be saying.
i'm speaking, i'm speaking, i tell you what,
i'm speaking, i'm speaking, i'm speaking.
next slide, next slide.
we're going to be a better place to go.
we're going to be a better place.
all right, thank you.
thank you so much for joining us today, thank you so much for joining us today.
okay, i got this stuff.
i said, good already, so i'm gonna switch.
i'm going to say it's good already, so i'm going to switch the side here.
i said good already, so i'm gonna try to switch the bike.
i said good already, so i'm going to switch the side too.
i got this at the time, i don't know about it.
i don't know.
everything all right.
so we're going to talk about this.
we're going to talk about this.
i am very good.
thank you so much for joining us today, thank you so much for joining us today, thank you so much for joining us today.
thank you so much for joining us, and we'll see you next time.
i'm going to be a bad person, i'm going to be a bad person, i'm going to be a bad person.
we're going to be a better person to go.
we're going to be a better person.
right here, right here.
right here.
we'll be right back.
oh, i just said that, i didn't see you in the hand.
i didn't see you in the hand.
i just went out.
i just went out and i just went out.
i just went out with his eyes.
uh-huh.
uh-huh, that's where i'm at.
uh-huh, that's where it's actually.
that's where i should go.
it's horrible.
i got this done.
i got this stuff.
you're doing good, i got this stuff.
all right, i got this.
i'm going to say it's good already, so i'm going to switch.
i'm going to switch the site.
i got this with the monolone.
i'm going to try the switch inside, too.
you know, i was like, oh, what's that?
you know, right?
you know
good.
all right, we're all alone.
all right, you know, all right?
all right, all right.""".split("\n"),
    "thank you, mr. president, " * 25 + "thank you, mr. president,",
    "thank you so much for joining us, " * 27 + "thank you so much for joining us",
    *EXTRAS,
)
